"""Helpers that several operators share: shared folders, text buffers, 64-bit mixing, connected classes."""

from __future__ import annotations

import ctypes
import functools
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrade.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write to a fresh folder that all executors share and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_trimmed_at = [0.0]


def give_back_memory(least_s: float = 1.0) -> None:
    """Return freed memory of this worker to the machine; workers live on between tasks and share it with the JVM.

    Called when a task or a group of rows is done, at most once in ``least_s`` seconds.
    """
    if time.monotonic() - _trimmed_at[0] < least_s:
        return
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim is not None:
            trim(0)
    _trimmed_at[0] = time.monotonic()


#: What workers remember between tasks, by the kind of work it is for; and the kind of a worker's last task.
CACHES: dict[str, list[dict]] = {}
_last_kind = [""]


def _begin(kind: str) -> None:
    """Drop what other kinds of work have left in this worker."""
    if _last_kind[0] != kind:
        for other, caches in CACHES.items():
            if other != kind:
                for cache in caches:
                    cache.clear()
        _last_kind[0] = kind
        give_back_memory(0.0)


def frugal(run, kind: str = ""):
    """A function for ``mapInArrow`` that gives memory back when its task ends.

    Caches that other kinds of work have left in the worker are dropped first, those of its own kind stay.
    """

    @functools.wraps(run)
    def wrapped(batches):
        _begin(kind)
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return wrapped


def frugal_group(run):
    """The same for ``applyInArrow``, after a group."""

    @functools.wraps(run)
    def wrapped(group):
        _begin("")
        try:
            return run(group)
        finally:
            give_back_memory()

    return wrapped


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd words, equal on every machine."""
    base = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix64(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, null as empty, and the offset of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return body, bounds - bounds[0]


def text_slices(batches, max_bytes: int = 2_000_000, max_rows: int = 4096, column: str = "text"):
    """Cut Arrow batches so that vectorised work on the text (or binary) column stays in bounded memory; one text may be larger."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, … of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: Links that one task can hold with ease (16 bytes each); more of them are classified by rounds of joins.
ONE_TASK_LINKS = 1 << 20


def _union_find(batches):
    """(node, class) of all nodes of the links of one partition: the smallest node reachable."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "class"])


def connected_classes(links: DataFrame, left: str, right: str, most: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, class): the smallest node reachable over the links, for every node that has one.

    Up to ``most`` links are classified in one task, which is quick and bounded. More of them by rounds that
    hang every neighbour on the smallest one of its larger and of its smaller side until nothing changes; only a
    count and a checksum reach the driver. Every round reads and writes a shared table, hub nodes are combined
    with map-side minima and the join is split by adaptive execution, so no task holds a whole class.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(a != b).distinct()
    edges = stored(edges, "links")
    if edges.count() <= most:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, class long")
    return _classes_by_rounds(edges)


def _classes_by_rounds(edges: DataFrame) -> DataFrame:
    """As ``connected_classes`` for a stored table of distinct links (a, b) with a > b."""
    a, b = F.col("a"), F.col("b")
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        stars = hung.join(low, "a").where(b != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(stars.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    smallest = edges.groupBy("a").agg(F.min("b").alias("class"))
    roots = edges.select(b.alias("node")).distinct().select("node", F.col("node").alias("class"))
    return smallest.select(a.alias("node"), "class").union(roots)
