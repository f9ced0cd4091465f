"""Token-id files in patched frame-of-reference blocks.

A file set is a folder of uncompressed Parquet, because executors reach the shared store through Spark's
writers only; each row is one segment of whole documents in ascending doc_id order. A segment holds blocks of
``BLOCK`` ids and an index of their starts. A block stores ids less the block's minimum, packed at the width
of the percentile that makes it smallest; the high bits of the ids above it are in an exception list.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygrade.llm.common import frugal, partitions_of, text_slices
from querygrade.llm.token_ids import ENCODING, encoder

#: Ids of a block; a multiple of 8, so that blocks are whole bytes, and places fit in one.
BLOCK = 256
#: Shares of a block's ids that may fit in its width.
PERCENTILES = (0.5, 0.75, 0.9, 0.97, 1.0)
#: Bytes of an exception: its place and its high bits.
EXCEPTION = 1 + 4
#: Ids after which a segment ends with the document.
SEGMENT = 1 << 16
#: Runs of byte-level vocabularies are not cut at marks, so there are more of them to remember.
REMEMBERED_SHARE = 2

_HEAD = struct.Struct("<4sIII")  # mark, ids, blocks, exceptions
_MARK = b"PFOR"
_INDEX = np.dtype([("start", "<u4"), ("base", "<u4"), ("width", "u1"), ("exceptions", "<u2")])

#: Widths that are those of a number.
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def _same_width(width: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, stop, width) of the runs of blocks that have one width, which lie one after the other."""
    cuts = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
    return [(a, b, int(width[a])) for a, b in zip(cuts, cuts[1:])]


def pack_ids(ids: np.ndarray) -> bytes:
    """Encode ids below 2^32. Layout: head, block index, packed blocks, exception places, exception high bits."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    index = np.zeros(blocks, _INDEX)
    if not blocks:
        return _HEAD.pack(_MARK, 0, 0, 0)
    index["base"] = full.min(axis=1)
    rest = full - index["base"][:, None]
    # The width of the id of a rank is that rank's width, so ids are sorted and few of them are measured.
    ranked = np.sort(rest, axis=1)
    choices = np.stack([np.frexp(ranked[:, int(np.ceil(p * (BLOCK - 1)))].astype(np.float64))[1] for p in PERCENTILES]).astype(np.uint8)
    most = ((np.uint64(1) << choices.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    costs = np.stack([c.astype(np.int64) * (BLOCK // 8) + EXCEPTION * np.count_nonzero(rest > m[:, None], axis=1) for c, m in zip(choices, most)])
    best = costs.argmin(axis=0), np.arange(blocks)
    width, over = choices[best], rest > most[best][:, None]
    index["width"], index["exceptions"] = width, np.count_nonzero(over, axis=1)
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    index["start"] = starts
    body = np.zeros(int(sizes.sum()), np.uint8)
    for first, stop, w in _same_width(width):
        own, at = rest[first:stop], body[starts[first] : starts[first] + (stop - first) * w * (BLOCK // 8)]
        if w in _WHOLE:  # little-endian ids of that size are the packed bits
            at[:] = own.astype(_WHOLE[w]).view(np.uint8).ravel()
        elif w:
            planes = (own[:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            at[:] = np.packbits(planes.ravel(), bitorder="little")
    which, where = np.nonzero(over)
    high = rest[which, where].astype(np.uint64) >> width[which].astype(np.uint64)
    head = _HEAD.pack(_MARK, n, blocks, len(where))
    return b"".join((head, index.tobytes(), body.tobytes(), where.astype("u1").tobytes(), high.astype("<u4").tobytes()))


def unpack_ids(data: bytes) -> np.ndarray:
    mark, n, blocks, exceptions = _HEAD.unpack_from(data)
    if mark != _MARK:
        raise ValueError("not a block of token ids")
    if not blocks:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(data, _INDEX, blocks, _HEAD.size)
    at = _HEAD.size + index.nbytes
    width = index["width"].astype(np.int64)
    body = np.frombuffer(data, np.uint8, int(width.sum()) * (BLOCK // 8), at)
    at += len(body)
    where = np.frombuffer(data, "u1", exceptions, at).astype(np.int64)
    high = np.frombuffer(data, "<u4", exceptions, at + exceptions)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for first, stop, w in _same_width(width):
        start = int(index["start"][first])
        packed = body[start : start + (stop - first) * w * (BLOCK // 8)]
        if w in _WHOLE:
            out[first:stop] = packed.view(_WHOLE[w]).reshape(-1, BLOCK)
        elif w:
            planes = np.unpackbits(packed, bitorder="little").reshape(-1, BLOCK, w)
            out[first:stop] = np.packbits(np.pad(planes, ((0, 0), (0, 0), (0, 32 - w))), axis=2, bitorder="little").view("<u4").reshape(-1, BLOCK)
    which = np.repeat(np.arange(blocks), index["exceptions"])
    out[which, where] |= high.astype(np.uint32) << width[which].astype(np.uint32)
    return (out + index["base"][:, None]).ravel()[:n]


def _segments(path: str, end_id: int):
    names = ["shard", "segment", "first", "ids", "doc_ids", "doc_lengths", "unnumbered", "blocks"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=True, share=REMEMBERED_SHARE).encode
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            numbered = np.array([d for d in docs if d is not None], np.int64)  # null ids sort first
            row = (shard, segment, first, held, numbered.tobytes(), lengths.tobytes(), len(docs) - len(numbered), pack_ids(np.concatenate(parts)))
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in text_slices(batches):
            for doc_id, ids in zip(batch.column(0).cast(pa.int64()).to_pylist(), encode(batch.column(1).to_pylist(), end_id)):
                docs.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= SEGMENT:
                    yield close()
                    segment, first = segment + 1, first + held
                    docs, parts, held = [], [], 0
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0) -> None:
    """Write the ids of all texts of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    Null doc_ids come first; rows of one doc_id are ordered by a hash of their text. Null and empty texts are the end id alone.
    An empty table writes a folder without segments. Columns besides doc_id and text are ignored.
    """
    # Rows of one doc_id, or without one, can lie in many ranges.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "hash", "place"]
    ordered = rows.repartitionByRange(partitions_of(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = "shard int, segment int, first long, ids long, doc_ids binary, doc_lengths binary, unnumbered long, blocks binary"
    ordered.mapInArrow(frugal(_segments(vocabulary, end_id), ENCODING), schema).write.option("compression", "none").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "doc_id", "local", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_ids(row["blocks"]).astype("<u4")
            lengths = np.frombuffer(row["doc_lengths"], np.int64)
            ends = np.cumsum(lengths)
            doc_ids = [None] * row["unnumbered"] + np.frombuffer(row["doc_ids"], np.int64).tolist()
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.record_batch([pa.array([row["shard"]] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], names)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 of all documents in the files; start counts the ids before it.

    Segments are decoded where they lie. Only the ids of each shard, one row a shard, are summed in one place.
    """
    schema = "shard int, segment int, first long, ids long, doc_ids binary, doc_lengths binary, unnumbered long, blocks binary"
    files = spark.read.schema(schema).parquet(folder)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    found = files.mapInArrow(_documents, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
