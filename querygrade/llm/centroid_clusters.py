"""Centroid clustering of integer vectors with the Shallot search.

Every vector remembers its nearest and its second-nearest centroid, an upper bound of the distance to the first
and a lower bound of the distance to all others. While the upper bound is below the lower one its centroid can't
change and nothing is computed. Otherwise both remembered centroids are measured, the closer one is where the
search starts, and its neighbours are scanned in ascending distance. The ball that holds all centroids which can
still be nearest or second nearest has the radius (distance to the start) + (second smallest distance so far), and
shrinks as that distance does. Those inside the ball are compared by squared integer distances, ties by number.

A round is one narrow pass over a stored table and a sum of at most centroids x components rows for each task.
Only centroids and those sums pass the driver. Bounds are rounded outwards, so they never decide a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import stored

#: Components of a vector, what they are multiplied by, centroids and rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Integers from here on take no part: squared distances of 64 of them would leave 64 bits.
TOO_LARGE = 1 << 27
#: Bounds are moved outwards by this share, far more than the rounding of a square root.
SLACK = 1e-12

_STATE = "vec_id long, vector array<int>, near int, second int, upper double, lower double"


def integer_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): rows with exactly ``dims`` finite components, each as floor(scale * x).

    Rows with an integer of 2^27 or more, positive or negative, are left out: their distances don't fit a long.
    """
    fits = lambda x: x.isNotNull() & (F.abs(F.floor(x.cast("double") * scale)) < TOO_LARGE)  # noqa: E731  false for infinities
    usable = (F.size("embedding") == dims) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & fits(x), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def first_centroids(vectors: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the smallest sha256 of salt and vec_id, in that order; equal ids by their vectors, rows without one as if it were empty."""
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["vector"] for r in vectors.orderBy(named, "vector").limit(count).collect()], np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


class Neighbours:
    """For each centroid the others by ascending distance, with lower bounds of those distances."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        squared = np.array([_squared(centroids, c) for c in centroids]).reshape(k, k)
        squared[np.arange(k), np.arange(k)] = -1
        self.order = np.argsort(squared, axis=1, kind="stable")[:, 1:]
        self.gaps = _below(np.take_along_axis(squared, self.order, axis=1))


def shallot(x: np.ndarray, centroids: np.ndarray, beside: Neighbours, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring near, second, upper and lower of all rows up to date, in place; gives the number of distances computed."""
    rows = np.flatnonzero(~(upper < lower))
    best = _squared(x[rows], centroids[near[rows]])
    upper[rows] = _above(best)
    computed = len(rows)
    left = ~(upper[rows] < lower[rows])
    rows, best = rows[left], best[left]
    if len(centroids) == 1 or not len(rows):
        lower[rows] = np.inf
        return computed
    body, first, other = x[rows], near[rows], second[rows]
    runner = _squared(body, centroids[other])
    computed += len(rows)
    swap = (runner < best) | ((runner == best) & (other < first))
    first, other, best, runner = np.where(swap, other, first), np.where(swap, first, other), np.where(swap, runner, best), np.where(swap, best, runner)
    start, known, reach = first.copy(), other.copy(), _above(best)
    active = np.arange(len(rows))
    for step in range(len(centroids) - 1):
        ball = reach[active] + _above(runner[active])
        active = active[beside.gaps[start[active], step] <= ball]
        if not len(active):
            break
        names = beside.order[start[active], step]
        fresh = names != known[active]
        at, names = active[fresh], names[fresh]
        found = _squared(body[at], centroids[names])
        computed += len(at)
        wins = (found < best[at]) | ((found == best[at]) & (names < first[at]))
        places = ~wins & ((found < runner[at]) | ((found == runner[at]) & (names < other[at])))
        other[at] = np.where(wins, first[at], np.where(places, names, other[at]))
        runner[at] = np.where(wins, best[at], np.where(places, found, runner[at]))
        first[at] = np.where(wins, names, first[at])
        best[at] = np.where(wins, found, best[at])
    near[rows], second[rows], upper[rows], lower[rows] = first, other, _above(best), _below(runner)
    return computed


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _moved(bounds: tuple[np.ndarray, np.ndarray], near: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after every centroid went at most so far: the own one away, the farthest other one closer."""
    upper, lower = bounds
    far = np.argsort(-moves, kind="stable")[:2]
    others = np.where(near == far[0], moves[far[-1]] if len(moves) > 1 else 0.0, moves[far[0]])
    return (upper + moves[near]) * (1 + SLACK), (lower - others) - np.abs(lower) * SLACK


def _assigning(centroids: np.ndarray, moves: np.ndarray | None) -> Callable:
    """One pass of assignment over rows of the state, or of (vec_id, vector) if there are no moves yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Neighbours(centroids)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(1))
            if moves is None:
                near, second = np.zeros(n, np.int64), np.full(n, min(1, len(centroids) - 1), np.int64)
                upper, lower = np.full(n, np.inf), np.full(n, -np.inf)
            else:
                near, second = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                upper, lower = _moved(tuple(batch.column(i).to_numpy() for i in (4, 5)), near, moves)
            shallot(x, centroids, beside, near, second, upper, lower)
            columns = [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.record_batch(columns, ["vec_id", "vector", "near", "second", "upper", "lower"])

    return run


def _summing(count: int) -> Callable:
    """(cluster, dim, total, n) of all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sizes = None, np.zeros(count, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, near = _matrix(batch.column(0)), batch.column(1).to_numpy()
            totals = np.zeros((count, x.shape[1]), np.int64) if totals is None else totals
            order = np.argsort(near, kind="stable")
            own, starts = np.unique(near[order], return_index=True)
            totals[own] += np.add.reduceat(x[order], starts, axis=0)
            sizes += np.bincount(near, minlength=count)
        if totals is not None:
            dims = totals.shape[1]
            at = np.repeat(np.arange(count), dims)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.tile(np.arange(dims), count), pa.int32()), pa.array(totals.ravel()), pa.array(sizes[at])], ["cluster", "dim", "total", "n"])

    return run


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floor of the mean of each centroid's vectors; a centroid without one stays. Sums are decimals, so they don't overflow."""
    parts = state.select("vector", "near").mapInArrow(_summing(len(centroids)), "cluster int, dim int, total long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        if r["n"]:
            out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def _measured(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = batch.column(2).to_numpy()
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(_squared(_matrix(batch.column(1)), centroids[near]))], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(rows: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids): every usable vector with its nearest centroid after ``rounds`` rounds.

    Reads vec_id and embedding only, other columns may have any name. Rows that are no vector of ``dims`` finite
    components are left out, see ``integer_vectors``. Repeated rows and repeated or null vec_ids are vectors of
    their own. With fewer vectors than ``count`` each is a centroid. An empty table gives an empty table.
    """
    vectors = stored(integer_vectors(rows, dims, scale), "vectors")
    centroids = first_centroids(vectors, count, salt)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    state, moves = vectors, None
    for _ in range(rounds):
        state = stored(state.mapInArrow(_assigning(centroids, moves), _STATE), "assigned")
        fresh = next_centroids(state, centroids)
        moves, centroids = _above(_squared(fresh, centroids)), fresh
    last = state.mapInArrow(_assigning(centroids, moves), _STATE)
    return stored(last.mapInArrow(_measured(centroids), "vec_id long, cluster int, distance long"), "clusters"), centroids


def cluster_digests(rows: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all vectors, sha256 of the centroid's components."""
    found, centroids = cluster_vectors(rows)
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # CENTROIDS rows at most
    total = sum(r["cluster_inertia"] for r in by_cluster)
    texts = [(r["cluster"], r["cluster_inertia"], total, ",".join(map(str, centroids[r["cluster"]].tolist()))) for r in by_cluster]
    kinds = "cluster int, cluster_inertia long, inertia long, components string"
    about = rows.sparkSession.createDataFrame(texts, kinds).withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "2:") -> str:
    """The same clustering in DuckDB: all distances of every round."""
    parts = [
        f"""whole AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE len(embedding) = {dims}),
p AS MATERIALIZED (SELECT vec_id, i, floor({scale} * e)::BIGINT AS x FROM whole
  WHERE vec_id NOT IN (SELECT vec_id FROM whole WHERE e IS NULL OR NOT isfinite(e))),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM p)),
c0 AS MATERIALIZED (SELECT c, i, x FROM starts JOIN p USING (vec_id) WHERE c < {count})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min(d * {count} + c) AS k FROM
  (SELECT vec_id, c, sum((p.x - c{r}.x) * (p.x - c{r}.x)) AS d FROM p JOIN c{r} USING (i) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT k % {count} AS c, i, sum(x) AS s, count(*) AS n FROM p JOIN a{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS x FROM c{r} LEFT JOIN m{r} USING (c, i))""")
    return f"""WITH {", ".join(parts)},
named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c),
found AS (SELECT vec_id, (k % {count})::INT AS cluster, (k // {count})::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM found JOIN named ON c = cluster"""
