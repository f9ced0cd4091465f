"""Packing of documents into sequences: shortest pack first over the length histogram.

The histogram of piece lengths has at most ``capacity`` rows, so the plan is made on the driver whatever the
number of documents: lengths are placed longest first, each into the pack with the most room, and whole groups
of equal packs move at once. The plan says which ranks of a length lie where; pieces are ranked on Spark and
looked up in it. Ranks are taken within blocks of a length, so a length that many pieces have is spread.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrade.llm.common import frugal, partitions_of, stored, text_slices
from querygrade.llm.token_ids import ENCODING, encoder

#: Tokens of a sequence.
CAPACITY = 4096


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first_rank, count, first_sequence, offset), sorted: where the pieces of each length go.

    Pieces first_rank … first_rank + count - 1 of that length lie at the offset of the sequences from
    first_sequence on. Every piece has a place, and no sequence holds more than ``capacity`` tokens.
    """
    parents, lengths, counts = [-1], [0], [0]
    room: list[tuple[int, int]] = []  # (-free, pack group)
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            if room and -room[0][0] >= length:
                free, group = -room[0][0], room[0][1]
                moved = min(left, counts[group])
                counts[group] -= moved
                if not counts[group]:
                    heapq.heappop(room)
            else:
                free, group, moved = capacity, 0, left
            parents.append(group)
            lengths.append(length)
            counts.append(moved)
            heapq.heappush(room, (length - free, len(parents) - 1))
            left -= moved
    slots, ranks, sequence = [], {}, 0
    for group in range(1, len(parents)):
        if not counts[group]:
            continue
        chain, at = [], group
        while at > 0:
            chain.append(lengths[at])
            at = parents[at]
        offset = 0
        for length in reversed(chain):
            rank = ranks.get(length, 0)
            slots.append((length, rank, counts[group], sequence, offset))
            ranks[length] = rank + counts[group]
            offset += length
        sequence += counts[group]
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=False).encode
        for batch in text_slices(batches):
            doc_ids = batch.column(0).cast(pa.int64()).to_pylist()
            rows = []
            for doc_id, ids in zip(doc_ids, encode(batch.column(1).to_pylist(), end_id)):
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _placed(shared_plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared_plan.value
        heads = (plan[:, 0] << 44) | plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = plan[np.searchsorted(heads, (length << 44) | rank, side="right") - 1]
            kept = batch.drop_columns(["rank"])
            kept = kept.append_column("sequence_id", pa.array(slot[:, 3] + rank - slot[:, 1]))
            yield kept.append_column("offset", pa.array(slot[:, 4]))

    return run


def packed_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document.

    A document is the ids of its text, white space dropped, followed by ``end_id``; it is cut after every
    ``capacity`` ids. Null and empty texts are one piece that holds the end id. Repeated rows are packed once
    each, null doc_ids too; columns besides doc_id and text are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stored(docs.mapInArrow(frugal(_pieces(vocabulary, end_id, capacity), ENCODING), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(shortest_pack_first(histogram, capacity))
    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(partitions_of(spark)))
    blocked = pieces.withColumn("block", block)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = blocked.withColumn("rank", F.row_number().over(own) - 1).join(sizes, ["length", "block"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placed(plan), schema + ", sequence_id long, offset long")
