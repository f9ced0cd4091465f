"""Near copies among vectors by an epsilon grid order join: all links with a cosine of at least a limit.

A cosine limit t is a distance limit eps = sqrt(2 - 2t) between unit vectors. A unit vector is described by its
coordinates on the leading principal dimensions and the length of the rest; descriptions are never further apart
than their vectors. Vectors are sorted by the eps-wide grid cells of their descriptions, first dimension first,
and cut into intervals of this sequence. Pairs of intervals are split again and again, from the whole
sequence down, and a pair whose boxes are more than eps apart is dropped. First this runs in Spark as one join
for each level of a tree over the intervals; every pair of intervals left is one task, which goes on down to
leaves. Two leaves are compared by the product of their descriptions, and what that can't rule out in double precision.

Equal vectors are one node with a count. A task gives link counts and spanning links of its nodes, never pairs, so
large groups of near copies stay small. A task holds two intervals, whose bytes are bounded. The principal
dimensions only decide how much is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import connected_classes, stored

#: Smallest cosine of a link.
COSINE = 0.95
#: Leading principal dimensions that order the vectors.
LEADING = 16
#: Longest vectors whose covariance is summed; longer ones, and those of rarer lengths, are ordered by their first components.
PRINCIPAL_DIMS = 512
#: Rows of a leaf; fewest rows of an interval, intervals until they reach their most bytes as doubles.
LEAF, FEWEST_ROWS, INTERVALS, INTERVAL_BYTES = 512, 1024, 8, 1 << 25
#: Children of a node in the tree over the intervals, as a power of two.
FAN = 4
#: Room for rounding in descriptions (single precision) and the cosines that are computed once more, exactly.
ROUGH, CLOSE = 1e-5, 1e-12


def usable(embedding: str = "embedding"):
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is divided out first, so no square over- or underflows."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _values(column: pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _covariance(length: int) -> Callable:
    """Sums of a task's unit vectors (row -1) and of their products, one row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total, seen = np.zeros((length, length)), np.zeros(length), False
        for batch in batches:
            if batch.num_rows:
                unit, seen = unit_rows(_values(batch.column(0), length)), True
                products += unit.T @ unit
                total += unit.sum(axis=0)
        if seen:
            at = np.repeat(np.arange(-1, length), length)
            flat = np.concatenate((total, products.ravel()))
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.tile(np.arange(length), length + 1), pa.int32()), pa.array(flat)], ["i", "j", "s"])

    return run


def leading_dimensions(vectors: DataFrame, length: int, rows: int) -> np.ndarray:
    """Orthonormal columns: the directions of greatest variance of the unit vectors of this length, over all of them."""
    sums = np.zeros((length + 1, length))
    own = vectors.where(F.size("embedding") == length).select("embedding")
    for r in own.mapInArrow(_covariance(length), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"] + 1, r["j"]] = r["s"]
    mean = sums[0] / rows
    _, directions = np.linalg.eigh(sums[1:] / rows - np.outer(mean, mean))
    return np.ascontiguousarray(directions[:, ::-1][:, :LEADING])


def described(unit: np.ndarray, leading: np.ndarray | None) -> np.ndarray:
    """Leading coordinates and the length of the rest. The product of two descriptions is at least their cosine."""
    near = unit[:, :LEADING] if leading is None or len(leading) != unit.shape[1] else unit @ leading
    near = np.pad(near, ((0, 0), (0, LEADING - near.shape[1])))
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", near, near), 0))
    return np.column_stack((near, rest)).astype(np.float32)


def sequence_keys(flat: np.ndarray, length: int, eps: float) -> np.ndarray:
    """Bytes that sort by length, then by grid cell of each dimension, then by the place inside the cells."""
    width = max(eps, 1e-3)
    cells = np.floor(flat / width)
    inside = ((flat / width - cells) * 65535).astype(">u2")
    head = np.full((len(flat), 1), length, ">u4").view(np.uint8).reshape(len(flat), 4)
    parts = [head, np.ascontiguousarray((cells + 32768).astype(">u2")).view(np.uint8), np.ascontiguousarray(inside).view(np.uint8)]
    return np.hstack([p.reshape(len(flat), -1) for p in parts])


def _keyed(leading: np.ndarray | None, eps: float) -> Callable:
    """Adds length and the key of the sequence; hashes of the vector end the key, so that no two nodes tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == length))
                flat = described(unit_rows(_values(own.column(4), length)), leading)
                marks = np.column_stack([own.column(i).to_numpy() for i in (0, 1)]).astype(">i8").view(np.uint8).reshape(len(flat), 16)
                keys = np.ascontiguousarray(np.hstack((sequence_keys(flat, length, eps), marks)))
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(keys)]).cast(pa.binary())
                yield pa.record_batch([*own.columns, pa.array(np.full(own.num_rows, length), pa.int32()), key], [*own.schema.names, "length", "key"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the partition and the place in it, which is the place in its part of the sequence."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [*batch.columns[:-1], pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(place, place + n))]
        place += n
        yield pa.record_batch(columns, [*batch.schema.names[:-1], "part", "place"])


def _sliced(leading: np.ndarray | None) -> Callable:
    """An interval as rows of at most 4 096 vectors in order, each with its box."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        length, out = group["length"][0].as_py(), []
        for start in range(0, group.num_rows, 4096):
            own = group.slice(start, 4096)
            values = _values(own["embedding"], length)
            flat = described(unit_rows(values), leading).astype(np.float64)
            out.append((length, own["interval"][0].as_py(), own["node"][0].as_py(), np.ascontiguousarray(values).tobytes(), own["copies"].to_numpy().tobytes(), flat.min(axis=0), flat.max(axis=0)))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["length", "interval", "first", "body", "copies", "low", "high"])

    return run


def _within(eps: float, a: str, b: str):
    """Whether two boxes come as close as eps, with room for rounding."""
    apart = [F.greatest(F.lit(0.0), F.col(f"{a}.low")[k] - F.col(f"{b}.high")[k], F.col(f"{b}.low")[k] - F.col(f"{a}.high")[k]) for k in range(LEADING + 1)]
    return sum((x * x for x in apart), F.lit(0.0)) <= (eps + ROUGH) ** 2


def close_intervals(slices: DataFrame, last: int, eps: float) -> DataFrame:
    """(length, x, y) with x <= y: the pairs of intervals that may hold a link, from the whole sequence down a tree."""
    corners = [F.array(*[F.min(F.col("low")[k]) for k in range(LEADING + 1)]).alias("low"), F.array(*[F.max(F.col("high")[k]) for k in range(LEADING + 1)]).alias("high")]
    level = stored(slices.groupBy("length", F.col("interval").alias("at")).agg(*corners), "boxes")
    levels = [level]
    while last >> (FAN * (len(levels) - 1)):
        level = level.groupBy("length", F.shiftright("at", FAN).alias("at")).agg(*corners)
        levels.append(level)
    pairs = levels[-1].select("length", F.col("at").alias("x"), F.col("at").alias("y"))
    children = lambda name: F.explode(F.sequence(F.shiftleft(name, FAN), F.shiftleft(name, FAN) + (1 << FAN) - 1)).alias(name)
    for level in reversed(levels[:-1]):
        pairs = pairs.select("length", children("x"), "y").select("length", "x", children("y")).where(F.col("x") <= F.col("y"))
        for side in ("x", "y"):
            pairs = pairs.join(level.select("length", F.col("at").alias(side), F.struct("low", "high").alias(f"box_{side}")), ["length", side])
        pairs = stored(pairs.where(_within(eps, "box_x", "box_y")).select("length", "x", "y"), "pairs")
    return pairs


class Side:
    """One interval in a task: unit vectors, descriptions, and the boxes of all nodes of a binary tree over its leaves."""

    def __init__(self, rows: list[dict], length: int, kind: type, leading: np.ndarray | None):
        rows = sorted(rows, key=lambda r: r["first"])
        self.first = rows[0]["first"]
        self.unit = unit_rows(np.concatenate([np.frombuffer(r["body"], kind) for r in rows]).reshape(-1, length))
        self.copies = np.concatenate([np.frombuffer(r["copies"], np.int64) for r in rows])
        self.flat = described(self.unit, leading)
        starts = np.arange(0, len(self.flat), LEAF)
        low, high = np.minimum.reduceat(self.flat, starts, axis=0), np.maximum.reduceat(self.flat, starts, axis=0)
        self.levels = [(low, high)]
        while len(low) > 1:
            even = np.arange(0, len(low), 2)
            low, high = np.minimum.reduceat(low, even, axis=0), np.maximum.reduceat(high, even, axis=0)
            self.levels.append((low, high))

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, (i + 1) * LEAF)


def close_leaves(a: Side, b: Side, eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may hold a link; of one side with itself each pair once."""
    open_pairs = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while open_pairs:
        level_a, i, level_b, j = open_pairs.pop()
        if a is b and i > j:
            continue
        low_a, high_a = (side[i] for side in a.levels[level_a])
        low_b, high_b = (side[j] for side in b.levels[level_b])
        apart = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
        if apart @ apart > (eps + ROUGH) ** 2:
            continue
        if level_a == level_b == 0:
            yield i, j
            continue
        halves = lambda side, level, k: [(level, k)] if level == 0 else [(level - 1, n) for n in (2 * k, 2 * k + 1) if n < len(side.levels[level - 1][0])]
        open_pairs += [(*x, *y) for x in halves(a, level_a, i) for y in halves(b, level_b, j)]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    dot = lambda x, y: math.fsum((x * y).tolist())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def linked(a: Side, at_a: slice, b: Side, at_b: slice, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in both leaves of all pairs whose cosine reaches the share."""
    may = a.flat[at_a] @ b.flat[at_b].T >= share - ROUGH
    if a is b and at_a == at_b:
        may &= np.tri(len(may), k=-1, dtype=bool).T
    i, j = np.nonzero(may)
    if len(i) * 8 > may.size:
        cosine = (a.unit[at_a] @ b.unit[at_b].T)[i, j]
    else:
        cosine = np.concatenate([np.einsum("ij,ij->i", a.unit[at_a][i[s : s + 4096]], b.unit[at_b][j[s : s + 4096]]) for s in range(0, len(i), 4096)] or [np.zeros(0)])
    keep = cosine >= share
    for k in np.flatnonzero(np.abs(cosine - share) < CLOSE).tolist():
        keep[k] = exact_cosine(a.unit[at_a][i[k]], b.unit[at_b][j[k]]) >= share
    return i[keep] + at_a.start, j[keep] + at_b.start


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Hang the larger root of every link on the smallest root beside it until both ends have one root."""
    while len(u):
        x, y = _roots(parent, u), _roots(parent, v)
        apart = x != y
        u, v = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))


def _tile(kind: type, leading: np.ndarray | None, share: float, eps: float) -> Callable:
    """Of one pair of intervals: links of each node (weighted by copies) and the smallest node joined with it."""

    def run(group: pa.Table) -> pa.Table:
        length, x, y = (group[name][0].as_py() for name in ("length", "x", "y"))
        rows = group.select(["interval", "first", "body", "copies"]).to_pylist()
        a = Side([r for r in rows if r["interval"] == x], length, kind, leading)
        b = a if x == y else Side([r for r in rows if r["interval"] == y], length, kind, leading)
        del rows
        shift = 0 if a is b else len(a.copies)
        copies = a.copies if a is b else np.concatenate((a.copies, b.copies))
        links, parent = np.zeros(len(copies), np.int64), np.arange(len(copies))
        for i, j in close_leaves(a, b, eps):
            u, v = linked(a, a.leaf(i), b, b.leaf(j), share)
            if len(u):
                v = v + shift
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                _unite(parent, u, v)
        nodes = np.arange(len(a.copies)) + a.first
        nodes = nodes if a is b else np.concatenate((nodes, np.arange(len(b.copies)) + b.first))
        own = np.flatnonzero(links)
        return pa.table([nodes[own], links[own], nodes[_roots(parent, own)]], ["node", "links", "root"])

    return run


def near_copies(rows: DataFrame, share: float = COSINE) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding; more columns are ignored).

    n_links counts the other rows whose vector has a cosine of at least ``share`` with the row's, component_id is the
    smallest vec_id reachable over links, kept whether that is the row's own. Vectors of different lengths don't link.
    Null and zero vectors and those with null or non-finite components link with nothing: each is its own component.
    Equal rows are rows of their own, linked with each other. Rows without a vec_id link as others do, but name no
    component; where no row of a component has one it is null, and those rows are kept. An empty table gives an empty table.
    """
    spark, eps = rows.sparkSession, math.sqrt(2 - 2 * share)
    single = rows.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    marked = rows.where(usable()).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    vectors = marked.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    vectors = stored(vectors, "distinct")
    size = F.size("embedding")
    total, longest = vectors.agg(F.count("*"), F.max(size)).first()
    if not total:
        return alone.withColumn("kept", F.lit(True))
    length, count = vectors.groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    leading = leading_dimensions(vectors, length, count) if length <= PRINCIPAL_DIMS else None
    kinds = vectors.schema.simpleString()[len("struct<") : -1] + ",length:int"
    keyed = vectors.mapInArrow(_keyed(leading, eps), kinds + ",key:binary").repartitionByRange("key").sortWithinPartitions("key")
    ordered = stored(keyed.mapInArrow(_numbered, kinds + ",part:int,place:bigint"), "ordered")
    ends, offsets = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((part, ends))
        ends += n
    interval = min(max(FEWEST_ROWS, -(-total // INTERVALS)), max(INTERVAL_BYTES // (8 * longest), 1))
    placed = ordered.join(F.broadcast(spark.createDataFrame(offsets, "part int, start long")), "part").withColumn("node", F.col("start") + F.col("place"))
    placed = placed.withColumn("interval", F.expr(f"node div {interval}"))
    body = placed.select("length", "interval", "node", "copies", "embedding").groupBy("length", "interval").applyInArrow(
        _sliced(leading), "length int, interval long, first long, body binary, copies binary, low array<double>, high array<double>"
    )
    slices = stored(body, "slices")
    pairs = close_intervals(slices, (total - 1) // interval, eps)
    ends_of = F.explode(F.array_distinct(F.array("x", "y"))).alias("interval")
    tiles = pairs.select("length", "x", "y", ends_of).join(slices.select("length", "interval", "first", "body", "copies"), ["length", "interval"])
    kind = np.float32 if single else np.float64
    found = stored(tiles.groupBy("length", "x", "y").applyInArrow(_tile(kind, leading, share, eps), "node long, links long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_classes(found, "node", "root")
    nodes = placed.select("node", "h1", "h2", "copies", "least").join(counts, "node", "left").join(classes, "node", "left")
    nodes = stored(nodes.withColumn("class", F.coalesce("class", "node")), "nodes")
    firsts = nodes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = nodes.join(firsts, "class").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = marked.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_copies_sql(share: float = COSINE) -> str:
    """The same in DuckDB: all pairs, and all nodes reachable from each."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {share}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), firsts AS (SELECT a, min(b) AS f FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(f, vec_id)) AS component_id, vec_id <= coalesce(f, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN firsts s ON s.a = vec_id"""
