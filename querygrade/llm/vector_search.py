"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into parts of equal size; a small network
learns which parts a vector's neighbours lie in. Every row goes to its most probable part, every query to its
most probable parts, and all their rows are ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrade.llm.common import stored

#: Neighbours of a query; rows the parts are learned from; neighbours of a row in the graph.
NEAREST = 20
SAMPLE = 8192
DEGREE = 12
#: Vectors for each part, until there are MOST_PARTS of them.
PART_ROWS = 160
MOST_PARTS = 256
#: Recall that the share of parts searched must reach on PROBES rows of the sample kept from learning.
RECALL = 0.94
PROBES = 768
#: Rows and queries that meet in one task at most, about.
BLOCK = 4096
#: Hidden units and steps of the network.
HIDDEN, STEPS = 128, 400


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) once for each vec_id: vectors without null or non-finite components and not all zero.

    Of several vectors of one vec_id the smallest takes part; of vectors of different lengths the commonest length.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<float>")).alias("embedding"))
    rows = stored(rows.withColumn("length", F.size("embedding")), "vectors")
    common = rows.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.col("length") == (common["length"] if common else 0)).select("vec_id", "embedding")


def neighbour_graph(vectors: np.ndarray) -> np.ndarray:
    """For each row the places of its nearest rows by inner product."""
    degree = min(DEGREE, len(vectors) - 1)
    out = np.zeros((len(vectors), max(degree, 0)), np.int64)
    for a in range(0, len(vectors), 512):
        products = vectors[a : a + 512] @ vectors.T
        products[np.arange(len(products)), a + np.arange(len(products))] = -np.inf
        if degree > 0:
            out[a : a + 512] = np.argpartition(-products, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node: halves the graph again and again at the median of its second eigenvector, then swaps nodes
    between the halves while that keeps more neighbours together."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    rng = np.random.default_rng(7)
    count = 1
    while count < parts:
        inner = label[a] == label[b]
        x, y = a[inner], b[inner]
        degree = np.maximum(np.bincount(x, minlength=n), 1)
        sizes = np.maximum(np.bincount(label, minlength=count), 1)
        value = rng.standard_normal(n)
        for _ in range(40):
            value = 0.5 * value + 0.5 * np.bincount(x, value[y], n) / degree
            value -= (np.bincount(label, value, count) / sizes)[label]
            value /= np.sqrt(np.bincount(label, value**2, count) / sizes + 1e-30)[label]
        order = np.lexsort((value, label))
        starts = np.concatenate(([0], np.cumsum(np.bincount(label, minlength=count))))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - starts[label[order]]
        side = (rank >= (np.bincount(label, minlength=count)[label] + 1) // 2).astype(np.int64)
        for _ in range(8):
            other = np.bincount(x, side[y] != side[x], n) * 2 - np.bincount(x, minlength=n)  # links gained by a move
            moved = False
            for part in range(count):
                nodes = np.flatnonzero(label == part)
                left, right = (nodes[side[nodes] == s] for s in (0, 1))
                left, right = left[np.argsort(-other[left], kind="stable")], right[np.argsort(-other[right], kind="stable")]
                m = min(len(left), len(right))
                swap = int((other[left[:m]] + other[right[:m]] > 0).sum()) // 2
                if swap:
                    side[left[:swap]], side[right[:swap]] = 1, 0
                    moved = True
            if not moved:
                break
        label = label * 2 + side
        count *= 2
    return label


@dataclass
class Router:
    """A network with one hidden layer that gives each part's probability."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.maximum(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)), 1e-30)[:, None]
        hidden = np.maximum(unit @ self.w1 + self.b1, 0)
        out = hidden @ self.w2 + self.b2
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def fit_router(vectors: np.ndarray, parts: int) -> Router:
    """Learn the parts of the sample: the target of a row is the share of its neighbours in each part."""
    graph = neighbour_graph(vectors)
    label = balanced_parts(graph, parts) if len(vectors) > 1 else np.zeros(len(vectors), np.int64)
    target = np.zeros((len(vectors), parts))
    np.add.at(target, (np.repeat(np.arange(len(vectors)), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(len(vectors)), label] += max(graph.shape[1], 1)
    target /= target.sum(axis=1, keepdims=True)
    unit = (vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-30)[:, None]).astype(np.float32)
    target = target.astype(np.float32)
    rng = np.random.default_rng(11)
    width = vectors.shape[1]
    weights = [w.astype(np.float32) for w in (rng.standard_normal((width, HIDDEN)) * np.sqrt(2 / width) * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, len(unit), min(512, len(unit)))
        x, t = unit[rows], target[rows]
        hidden = np.maximum(x @ weights[0] + weights[1], 0)
        out = hidden @ weights[2] + weights[3]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        slope = (out / out.sum(axis=1, keepdims=True) - t) / len(rows)
        back = (slope @ weights[2].T) * (hidden > 0)
        for k, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def searched_share(router: Router, vectors: np.ndarray, probes: np.ndarray, parts: int) -> float:
    """Smallest share of the parts that holds RECALL of the probes' nearest rows of the sample."""
    near = np.argsort(-(probes @ vectors.T), axis=1, kind="stable")[:, :NEAREST]
    home = router.probabilities(vectors).argmax(axis=1)
    place = np.argsort(np.argsort(-router.probabilities(probes), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1), axis=None) + 1
    return needed[min(int(np.ceil(RECALL * len(needed))), len(needed)) - 1] / parts if len(needed) else 1.0


def _homes(shared):
    """The most probable part of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.probabilities(_matrix(batch.column(1))).argmax(axis=1)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    return run


def _routes(shared, share: float):
    """For each query the blocks it searches, and its parts in each: its most probable parts, with NEAREST rows at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, sizes, block_of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.probabilities(_matrix(batch.column(1))), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) > NEAREST).argmax(axis=1) + 1
            enough = np.where(sizes.sum() > NEAREST, enough, len(sizes))
            counts = np.maximum(enough, int(np.ceil(share * len(sizes))))
            rows, blocks, parts = [], [], []
            for k, (own, count) in enumerate(zip(order, counts.tolist())):
                by_block: dict[int, list[int]] = {}
                for part in own[:count].tolist():
                    if sizes[part]:
                        by_block.setdefault(block_of[part], []).append(part)
                rows += [k] * len(by_block)
                blocks += by_block.keys()
                parts += by_block.values()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch([taken.column(0), taken.column(1), pa.array(blocks, pa.int32()), pa.array(parts, pa.list_(pa.int32()))], ["vec_id", "embedding", "block", "parts"])

    return run


def part_blocks(sizes: np.ndarray) -> list[int]:
    """Block of each part: parts that follow each other share one while they have BLOCK rows at most."""
    out, block, held = [], 0, 0
    for size in sizes.tolist():
        if held and held + size > BLOCK:
            block, held = block + 1, 0
        out.append(block)
        held += size
    return out


def _ranked(queries: pa.Table, rows: pa.Table) -> pa.Table:
    """Of one block of rows each query's nearest by exact inner product; equal vectors are compared once."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not rows.num_rows:
        return empty
    ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
    asked, probes = queries["vec_id"].to_numpy(), _matrix(queries["embedding"]).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    ids, parts, vectors = ids[order], rows["part"].to_numpy()[order], np.ascontiguousarray(vectors[order] + np.float32(0))
    _, firsts, which = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    distinct, home = vectors[firsts].astype(np.float64), parts[firsts]
    wanted = np.zeros((len(asked), int(max(home.max(), pc.max(pc.list_flatten(queries["parts"])).as_py())) + 1), bool)
    for q, own in enumerate(queries["parts"].to_pylist()):
        wanted[q, own] = True
    grouped = np.argsort(which, kind="stable")  # ids ascend within a vector
    bounds = np.searchsorted(which[grouped], np.arange(len(firsts) + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keep = min(NEAREST + 1, len(firsts))  # the query's own vector may be one of them
    lengths = np.sqrt((distinct**2).sum(axis=1)).max()
    for a in range(0, len(asked), 256):
        products = np.where(wanted[a : a + 256][:, home], probes[a : a + 256] @ distinct.T, -np.inf)
        last = np.partition(products, len(firsts) - keep, axis=1)[:, len(firsts) - keep]
        # All vectors that may tie with the last one kept, whatever their number; a product is exact to far less than this.
        last = last - 1e-9 * lengths * np.sqrt((probes[a : a + 256] ** 2).sum(axis=1))
        for q, own, least in zip(range(a, a + len(products)), products, last):
            places = np.flatnonzero((own >= least) & (own > -np.inf))
            if not len(places):
                continue
            exact = (distinct[places] * probes[q]).sum(axis=1)
            members = [ids[grouped[bounds[p] : min(bounds[p + 1], bounds[p] + NEAREST + 1)]] for p in places]
            found = np.concatenate(members)
            score = np.repeat(exact, [len(m) for m in members])
            other = found != asked[q]
            found, score = found[other], score[other]
            top = np.lexsort((found, -score))[:NEAREST]
            out.append((np.full(len(top), asked[q]), found[top], score[top]))
    if not out:
        return empty
    return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score"))})


def nearest_neighbours(rows: DataFrame, every: int = 20) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the NEAREST rows found for each query, nearest first.

    Queries are the rows whose vec_id is divisible by ``every``; nearness is the inner product in double
    precision, ties go to the smaller vec_id. Rows without a vec_id and unusable vectors take no part (see
    ``usable_vectors``). An empty table gives an empty table. With few rows all parts are searched.
    """
    context = rows.sparkSession.sparkContext
    vectors = usable_vectors(rows)
    total = vectors.count()
    parts = 1
    while parts < min(total / PART_ROWS, MOST_PARTS):
        parts *= 2
    places, wanted = 1 << 20, SAMPLE + PROBES
    sample = vectors if total <= wanted else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(places)) < int(places * wanted / total))
    learned = _matrix(sample.orderBy(F.xxhash64("vec_id"), "vec_id").toArrow()["embedding"]).astype(np.float64) if total else np.zeros((1, 1))
    probes = learned[: min(PROBES, len(learned) // 4)]
    router = fit_router(learned[len(probes) :], parts)
    share = searched_share(router, learned[len(probes) :], probes, parts)
    placed = stored(vectors.mapInArrow(_homes(context.broadcast(router)), "vec_id long, embedding array<float>, part int"), "placed")
    sizes = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    block_of = part_blocks(sizes)
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    routes = _routes(context.broadcast((router, sizes, block_of)), share)
    routed = stored(asked.mapInArrow(routes, "vec_id long, embedding array<float>, block int, parts array<int>"), "routed")
    blocked = placed.withColumn("block", F.element_at(F.array(*map(F.lit, block_of)), F.col("part") + 1))
    loads = routed.groupBy("block").count().select("block", F.ceil(F.col("count") / BLOCK).alias("query_blocks"))
    shares = blocked.groupBy("block").count().select("block", F.ceil(F.col("count") / BLOCK).alias("row_blocks"))
    plan = F.broadcast(loads.join(shares, "block"))  # one row for each block, MOST_PARTS at most
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = routed.join(plan, "block").select("block", "parts", "vec_id", "embedding", dealt("query_blocks").alias("query_block"), spread("row_blocks").alias("row_block"))
    candidates = blocked.join(plan, "block").select("block", "part", "vec_id", "embedding", dealt("row_blocks").alias("row_block"), spread("query_blocks").alias("query_block"))
    keys = ["block", "query_block", "row_block"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_ranked, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")
