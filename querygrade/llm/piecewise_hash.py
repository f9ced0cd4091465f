"""Context-triggered piecewise hashing: fingerprints that change only where a text changes.

A rolling hash over seven bytes ends a chunk where it hits the block size's trigger, and each chunk becomes one
character of the signature, so an edit changes the characters around it only. A fingerprint is
``block:signature:signature at twice the block size``. Two fingerprints are compared at equal block sizes by
the edit distance of their signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrade.llm.common import mix64, partitions_of, random64, text_slices

#: Bytes the rolling hash sees; smallest block size; characters of a signature.
WINDOW = 7
SMALLEST = 3
SIGNATURE = 64
#: Characters in a row that two signatures must share to be compared at all, or all of a shorter one.
SHARED_RUN = 7

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PLACES = random64(WINDOW, 31)
_BYTES = random64(256, 32)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _signature(body: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> str:
    """One character for each chunk; the last character stands for all that is left."""
    starts = np.concatenate(([0], ends[: SIGNATURE - 1] + 1))
    starts = starts[starts < len(body)]
    if not len(starts):
        return ""
    sums = np.add.reduceat(_BYTES[body] * up[: len(body)], starts) * down[starts]
    return _ALPHABET[(mix64(sums) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of UTF-8 texts. The block size is the largest 3 * 2^k that gives at least half a signature."""
    longest = max(map(len, texts), default=0)
    up, down = _powers(_BASE, longest), _powers(_INVERSE, longest)
    out = []
    for text in texts:
        body = np.frombuffer(text, np.uint8)
        n = len(body)
        block = SMALLEST
        while block * SIGNATURE < n:
            block *= 2
        rolled = np.zeros(n, np.uint64)
        for k in range(min(WINDOW, n)):
            rolled[k:] += _BYTES[body[: n - k]] * _PLACES[k]
        rolled = mix64(rolled) >> np.uint64(20)
        # a trigger of a block size is one of every smaller block size that divides it
        rest = np.flatnonzero(rolled % np.uint64(SMALLEST) == 0)
        level = rolled[rest] // np.uint64(SMALLEST)
        ends = lambda size: rest[level % np.uint64(size // SMALLEST) == 0]
        found = ends(block)
        while block > SMALLEST and len(found) < SIGNATURE // 2:
            block //= 2
            found = ends(block)
        out.append(f"{block}:{_signature(body, found, up, down)}:{_signature(body, ends(2 * block), up, down)}")
    return out


def _edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of many pairs of signatures at once, one bit for each character of the first."""
    n = len(a)
    codes = lambda rows: np.frombuffer("".join(r.ljust(SIGNATURE, "\0") for r in rows).encode(), np.uint8).reshape(n, SIGNATURE)
    left, right = codes(a), codes(b)
    size_a, size_b = (np.fromiter(map(len, rows), np.int64, n) for rows in (a, b))
    one = np.uint64(1)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    distance, top = size_a.copy(), one << np.maximum(size_a - 1, 0).astype(np.uint64)
    for j in range(int(size_b.max(initial=0))):
        same = (left == right[:, j : j + 1]) & (left != 0)
        match = np.packbits(same, axis=1, bitorder="little").view(np.uint64)[:, 0]
        across = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(across | plus), plus & across
        going = j < size_b
        distance += np.where(going & (up & top != 0), 1, 0) - np.where(going & (down & top != 0), 1, 0)
        up, down = (up << one) | one, down << one
        through = match | minus
        plus, minus = np.where(going, down | ~(through | up), plus), np.where(going, up & through, minus)
    return np.where(size_a == 0, size_b, distance)


def _share_run(a: str, b: str) -> bool:
    run = min(SHARED_RUN, len(a), len(b))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    return run > 0 and any(b[i : i + run] in runs for i in range(len(b) - run + 1))


def likeness(first: list[str], second: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints from 0 to 1: 1 for equal ones; 0 if their block sizes are neither equal nor
    one twice the other, or no run of characters is shared; else the share of characters that need no edit, at the
    better of the block sizes both have."""
    best = np.array([float(a == b) for a, b in zip(first, second)])
    lefts, rights, rows = [], [], []
    for k, (a, b) in enumerate(zip(first, second)):
        if a == b:
            continue
        size_a, own_a, twice_a = a.split(":")
        size_b, own_b, twice_b = b.split(":")
        x, y = int(size_a), int(size_b)
        pairs = [(own_a, own_b), (twice_a, twice_b)] if x == y else [(own_a, twice_b)] if x == 2 * y else [(twice_a, own_b)] if y == 2 * x else []
        for left, right in pairs:
            if _share_run(left, right):
                lefts.append(left)
                rights.append(right)
                rows.append(k)
    if rows:
        longest = np.maximum([len(x) for x in lefts], [len(x) for x in rights])
        np.maximum.at(best, rows, 1 - _edit_distances(lefts, rights) / longest)
    return best


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points is replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by range and in order; the last row of a range is a copy of the first one of the next range."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: list[tuple] = []  # the row whose following row has not come yet

    def rows_of(own: list[tuple]) -> pa.RecordBatch:
        """All rows but the last; every row's following row is the next one, if it is of the same range."""
        texts = [r[3] or "" for r in own]
        marks = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
        which = [i for i in range(len(own) - 1) if own[i][0] == own[i + 1][0] and not own[i][1]]
        changed = [edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass") for i in which]
        changed_marks = fingerprints(changed)
        near = likeness([marks[i] for i in which], changed_marks)
        following = likeness([marks[i] for i in which], [marks[i + 1] for i in which])
        columns = [[own[i][2] for i in which], [len(texts[i]) for i in which], [hashlib.sha256(c).hexdigest() for c in changed], [marks[i] for i in which], changed_marks, near, following]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in text_slices(batches):
        rows = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("range", "tail", "doc_id", "text"))))
        if len(held) + len(rows) > 1:
            yield rows_of(held + rows)
        held = rows[-1:]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The following row is the one next in order of doc_id (null first), rows of one doc_id by text; the last one's
    is the first. A single row follows itself. Null texts count as empty; an empty text's fingerprint is ``3::``.
    Texts are dealt once, by ranges of doc_id; each range also gets the first doc_id's rows of the next one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.select("doc_id")
    ranges = partitions_of(docs.sparkSession)
    cuts = ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    cuts = sorted({int(c) for c in cuts})
    # the range of an id is the number of cuts not above it, found by halving
    where = F.coalesce(_rank(F.col("doc_id"), cuts), F.lit(0))
    firsts = ids.select("doc_id", where.alias("range")).groupBy("range").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("doc_id"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy(F.lit(0))))
    heads = firsts.select("doc_id", before.alias("before"))  # one row for each range
    joined = docs.withColumn("range", where).join(F.broadcast(heads), docs["doc_id"].eqNullSafe(heads["doc_id"]), "left").drop(heads["doc_id"])
    places = F.array_compact(F.array(F.struct("range", F.lit(False).alias("tail")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")))))
    dealt = joined.select("doc_id", "text", F.inline(places)).repartition(ranges, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("range", "tail", "doc_id", "text").mapInArrow(_compare, schema)


def _rank(column, cuts: list[int]):
    """How many of the ascending cuts are at most the column's value, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < cuts[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(column.isNotNull(), tree(0, len(cuts)))
