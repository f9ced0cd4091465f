"""Seeded, exact sampling, shuffling and splitting.

Rows are ordered by ``md5(seed-id)``. Taking the first k of that order needs only the k-th
smallest hash: it is found from counts per hash prefix and the hashes inside the one prefix
that holds it, both read from the id column, for all parts at once. The rows themselves are then
kept by a filter, so they are never shuffled, and one seed gives nested samples. Ids must be
unique. Rows without an id are ordered by a hash of the whole row, so they are sampled too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 5
MOST_PREFIXES = 16**PREFIX_DIGITS

Take = Callable[[Column], Column]


def shuffle_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string")))


def row_key(frame: DataFrame, id_column: str, seed: int) -> Column:
    """The row's place in the seeded order: by its id, or by all its columns if it has none."""
    whole = F.md5(F.concat(F.lit(f"{seed}-no-id-"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]))))
    return F.coalesce(shuffle_key(id_column, seed), whole)


def share_rounded_down(weight: float) -> Take:
    return lambda n: F.floor(n.cast("double") * weight)


def share_rounded_up(weight: float) -> Take:
    return lambda n: F.ceil(n.cast("double") * weight)


@dataclass(frozen=True)
class Cutoff:
    """The hash of the last row taken, how many rows have it, and how many of those are taken."""

    hash: str
    taken: int
    tied: int


def find_cutoffs(parts: list[DataFrame], id_column: str, seed: int, takes: dict[str, tuple[int, Take]]) -> dict[str, Cutoff]:
    """The cutoff of each label, which takes some rows of the part of that number; no entry when none is taken.

    All parts are counted together, by (part, prefix of the hash), from their id columns. Then only the hashes inside the
    prefixes that hold a cutoff are looked at again. The driver gets one row for each label.
    """
    hashed = [part.select(F.lit(i).alias("part"), row_key(part, id_column, seed).alias("hash")) for i, part in enumerate(parts)]
    # Never null, or Spark would add a null filter to the join that computes the hash twice.
    prefix = F.coalesce(F.substring("hash", 1, PREFIX_DIGITS), F.lit("")).alias("prefix")
    hashes = reduce(DataFrame.union, hashed).select("part", "hash", prefix)
    # At most MOST_PREFIXES rows of a part, whatever the input.
    within = Window.partitionBy("part")
    counts = hashes.groupBy("part", "prefix").agg(F.count(F.lit(1)).alias("size"))
    running = counts.select(
        "part", "prefix", "size", F.sum("size").over(within.orderBy("prefix")).alias("reached"), F.sum("size").over(within).alias("n")
    )
    asked = [F.struct(F.lit(name).alias("label"), F.lit(i).alias("of"), take(F.col("n")).alias("k")) for name, (i, take) in takes.items()]
    before = F.col("reached") - F.col("size")
    cells = (
        running.select("*", F.explode(F.array(*asked)).alias("w"))
        .where((F.col("w.of") == F.col("part")) & (F.col("w.k") > before) & (F.col("w.k") <= F.col("reached")))
        .select("part", "prefix", F.col("w.label").alias("label"), (F.col("w.k") - before).alias("rest"))
    )
    # One row per label: bounded by the argument, not by the data.
    near = hashes.join(F.broadcast(cells), ["part", "prefix"]).groupBy("label", "rest", "hash").agg(F.count(F.lit(1)).alias("tied"))
    ranked = near.withColumn("reached", F.sum("tied").over(Window.partitionBy("label").orderBy("hash")))
    left = F.col("rest") - (F.col("reached") - F.col("tied"))
    last = ranked.where((left > 0) & (left <= F.col("tied"))).select("label", "hash", left.alias("taken"), "tied")
    return {r["label"]: Cutoff(r["hash"], r["taken"], r["tied"]) for r in last.collect()}


def _up_to(key: Column, cutoff: Cutoff | None) -> Column:
    return F.lit(False) if cutoff is None else key <= cutoff.hash


def _first_rows(frame: DataFrame, id_column: str, seed: int, cutoff: Cutoff | None) -> DataFrame:
    """The rows up to a cutoff; of equal rows that share its hash only as many as are taken."""
    if cutoff is None:
        return frame.where(F.lit(False))
    key = row_key(frame, id_column, seed)
    if cutoff.taken == cutoff.tied:
        return frame.where(key <= cutoff.hash)
    copies = frame.where(key == cutoff.hash).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("row"))
    copies = copies.select(F.explode(F.array_repeat("row", cutoff.taken)).alias("row")).select("row.*")
    return frame.where(key < cutoff.hash).unionByName(copies)


def subsample(frame: DataFrame, id_column: str, seed: int, weight: float) -> DataFrame:
    """Exactly ``int(rows * weight)`` rows; a weight of 1 gives the frame itself."""
    return subsample_parts([(frame, weight)], id_column, seed)[0]


def subsample_parts(parts: list[tuple[DataFrame, float | None]], id_column: str, seed: int) -> list[DataFrame]:
    """Of each part exactly ``int(rows * weight)`` rows; a weight of 1 or none gives the part itself.

    Ids must be unique within a part, but equal rows without an id are counted one by one too.
    """
    for _, weight in parts:
        if weight is not None and not 0 <= weight <= 1:
            raise ValueError(f"a weight lies between 0 and 1, not at {weight}")
    asked = {str(i): (i, share_rounded_down(weight)) for i, (_, weight) in enumerate(parts) if weight is not None and weight < 1}
    if not asked:
        return [frame for frame, _ in parts]
    cutoffs = find_cutoffs([frame for frame, _ in parts], id_column, seed, asked)
    return [_first_rows(frame, id_column, seed, cutoffs.get(str(i))) if str(i) in asked else frame for i, (frame, _) in enumerate(parts)]


def shuffled(frame: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Rows in seeded random order: a range-partitioned global sort."""
    return frame.orderBy(row_key(frame, id_column, seed))


def with_split(frame: DataFrame, id_column: str, seed: int, test_share: float) -> DataFrame:
    """Adds ``split``: ``test`` for ``ceil(rows * test_share)`` rows, else ``train``. Equal rows without an id stay together."""
    cutoffs = find_cutoffs([frame], id_column, seed, {"test": (0, share_rounded_up(test_share))})
    is_test = _up_to(row_key(frame, id_column, seed), cutoffs.get("test"))
    return frame.withColumn("split", F.when(is_test, "test").otherwise("train"))


def train_test_split(frame: DataFrame, id_column: str, seed: int = 2025, test_share: float = 0.2) -> dict[str, DataFrame]:
    labelled = with_split(frame, id_column, seed, test_share)
    return {name: labelled.where(F.col("split") == name).drop("split") for name in ("train", "test")}


def with_smallest_subset(frame: DataFrame, id_column: str, seed: int, halvings: int = 5) -> DataFrame:
    """Adds ``subset``: the largest halving step, 1/2 to 1/2^halvings, whose subset still holds the row.

    Subsets are nested: a row with subset s is in all subsets of at most s halvings; 0 means
    only the full set.
    """
    takes = {f"step{step}": (0, share_rounded_down(math.ldexp(1.0, -step))) for step in range(1, halvings + 1)}
    cutoffs = find_cutoffs([frame], id_column, seed, takes)
    key = row_key(frame, id_column, seed)
    total = sum((_up_to(key, cutoffs.get(name)).cast("int") for name in takes), F.lit(0))
    return frame.withColumn("subset", total)
