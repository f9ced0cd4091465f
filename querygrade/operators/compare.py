"""Comparison of predicted and gold result tables.

Input ``rows(pair_id, side, row_idx, cells)`` holds both result tables of every pair, with
``side`` either ``pred`` or ``gold``; ``executions(pair_id, pred_ok, gold_ok)`` holds one row
per pair, because an empty result leaves no row.

All metrics come from one shuffle of the rows by pair. Pairs with more than ``WHOLE_PAIRS`` rows, of which there can
be few, go another way: rows and cells are counted by ``(pair, kind, value)`` with map-side combining, and only those
counts are rolled up per pair, so such a pair is spread over its values and never lands in one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrade.functions.cells import cell_mark, row_key, row_mark, short_key

METRICS = (
    "cell_precision",
    "cell_recall",
    "tuple_cardinality",
    "tuple_constraint",
    "tuple_order",
    "bird_ex",
    "ex",
)
COMBINED = "cp_cr_tc"
BLOCK_BITS = 16
#: Most rows of a pair, of both sides, that go to one task.
WHOLE_PAIRS = 1 << 20


def count_values(rows: DataFrame) -> DataFrame:
    """Per pair and distinct row or cell: copies on each side, and first position of rows."""
    # Place 0 holds the row, the others its cells. Keys are built after the explode, where
    # they are compiled, not in an interpreted lambda.
    entries = F.posexplode(F.concat(F.array(row_mark(F.col("cells"))), "cells"))
    pred, is_row = F.col("side") == "pred", F.col("entry") == 0
    mark = F.when(is_row, F.col("mark")).otherwise(cell_mark(F.col("mark")))
    keyed = rows.select("pair_id", "side", "row_idx", entries.alias("entry", "mark")).select(
        "pair_id", "side", "row_idx", is_row.alias("is_row"), short_key(mark).alias("value")
    )
    is_row = F.col("is_row")
    return keyed.groupBy("pair_id", "is_row", "value").agg(
        F.count_if(pred).alias("n_pred"),
        F.count_if(~pred).alias("n_gold"),
        F.min(F.when(is_row & pred, F.col("row_idx"))).alias("first_pred"),
        F.min(F.when(is_row & ~pred, F.col("row_idx"))).alias("first_gold"),
    )


def _ranked(shared: DataFrame, position: str, rank: str) -> DataFrame:
    """Rank of ``position`` within each pair, exact and without sorting a pair in one task.

    Positions fall into blocks of fixed width. A row's rank is its place inside its block plus
    the sizes of the earlier blocks, so no sort ever sees more than one block of a pair.
    """
    block = F.shiftright(position, BLOCK_BITS).alias("block")
    blocked = shared.withColumn("block", block)
    earlier = Window.partitionBy("pair_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("pair_id", "block")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("pair_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    )
    within = F.row_number().over(Window.partitionBy("pair_id", "block").orderBy(position))
    return (
        blocked.withColumn("within", within)
        .join(starts, ["pair_id", "block"])
        .withColumn(rank, F.col("start") + F.col("within"))
        .drop("block", "within", "start")
    )


def order_agreement(counts: DataFrame, whole: bool = False) -> DataFrame:
    """``(pair_id, agreement)``: Spearman correlation of the shared rows' first positions, in [0, 1].

    Pairs are ranked in blocks of positions, or ``whole``, which takes no shuffle if ``counts`` are partitioned by pair.
    """
    # The counts are tested too, so this branch asks for the same columns as the metric
    # branch and Spark reuses one shuffle for both.
    shared = counts.where(
        (F.col("n_pred") > 0)
        & (F.col("n_gold") > 0)
        & F.col("first_pred").isNotNull()
        & F.col("first_gold").isNotNull()
    ).select("pair_id", "first_pred", "first_gold")
    if whole:
        place = lambda position: F.row_number().over(Window.partitionBy("pair_id").orderBy(position))
        ranked = shared.withColumn("rank_pred", place("first_pred")).withColumn("rank_gold", place("first_gold"))
    else:
        ranked = _ranked(_ranked(shared, "first_pred", "rank_pred"), "first_gold", "rank_gold")
    gap = (F.col("rank_pred") - F.col("rank_gold")).cast("double")
    n = F.col("n").cast("double")
    rho = 1 - 6 * F.col("gaps") / (n * (n * n - 1))
    return (
        ranked.groupBy("pair_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(gap * gap).alias("gaps"))
        .select("pair_id", F.when(n == 1, 1.0).otherwise((rho + 1) / 2).alias("agreement"))
    )


def _roll_up(counts: DataFrame) -> DataFrame:
    pred, gold, is_row = F.col("n_pred"), F.col("n_gold"), F.col("is_row")
    both = (pred > 0) & (gold > 0)
    total = lambda condition, value: F.sum(F.when(condition, value).otherwise(0))
    return counts.groupBy("pair_id").agg(
        total(is_row, pred).alias("pred_rows"),
        total(is_row, gold).alias("gold_rows"),
        F.count_if(is_row & (pred > 0) & (gold == 0)).alias("only_pred"),
        F.count_if(is_row & (gold > 0) & (pred == 0)).alias("only_gold"),
        F.count_if(is_row & (pred != gold)).alias("uneven"),
        F.count_if(is_row & (gold > 0)).alias("distinct_gold"),
        F.count_if(is_row & (gold > 0) & (pred == gold)).alias("even_gold"),
        F.count_if(F.col("first_pred").isNotNull() & F.col("first_gold").isNotNull()).alias("shared_rows"),
        total(~is_row, pred).alias("pred_cells"),
        total(~is_row, gold).alias("gold_cells"),
        total(~is_row & both, pred).alias("pred_hits"),
        total(~is_row & both, gold).alias("gold_hits"),
    )


def compare_results(rows: DataFrame, executions: DataFrame, with_order: bool = True, whole_pairs: int = WHOLE_PAIRS) -> DataFrame:
    """One row per pair of ``executions`` with every metric, each in [0, 1].

    A pair with an error on either side scores 0, two empty results score 1, one empty result
    scores 0.
    """
    # At most one pair for every whole_pairs rows.
    large = F.broadcast(rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole_pairs).select("pair_id"))
    whole = count_values(rows.join(large, "pair_id", "left_anti").repartition("pair_id"))
    spread = count_values(rows.join(large, "pair_id", "left_semi"))
    pairs = executions.select("pair_id", (F.col("pred_ok") & F.col("gold_ok")).alias("both_ran"))
    pairs = pairs.join(_roll_up(whole).unionByName(_roll_up(spread)), "pair_id", "left")
    if with_order:
        pairs = pairs.join(order_agreement(whole, whole=True).unionByName(order_agreement(spread)), "pair_id", "left")

    n_pred, n_gold = F.coalesce("pred_rows", F.lit(0)), F.coalesce("gold_rows", F.lit(0))

    def metric(value: Column) -> Column:
        return (
            F.when(~F.col("both_ran"), 0.0)
            .when((n_pred == 0) & (n_gold == 0), 1.0)
            .when((n_pred == 0) | (n_gold == 0), 0.0)
            .otherwise(value)
        )

    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    values = {
        "cell_precision": metric(share("pred_hits", "pred_cells")),
        "cell_recall": metric(share("gold_hits", "gold_cells")),
        "tuple_cardinality": metric(F.try_divide(F.least(n_pred, n_gold).cast("double"), F.greatest(n_pred, n_gold))),
        "tuple_constraint": metric(share("even_gold", "distinct_gold")),
        "bird_ex": metric((F.col("only_pred") + F.col("only_gold") == 0).cast("double")),
        "ex": metric((F.col("uneven") == 0).cast("double")),
    }
    if with_order:
        values["tuple_order"] = metric(F.when(F.col("shared_rows") == 0, 0.0).otherwise(F.coalesce("agreement", F.lit(0.0))))
    parts = [values[name] for name in ("cell_precision", "cell_recall", "tuple_cardinality")]
    values[COMBINED] = (parts[0] + parts[1] + parts[2]) / 3
    ordered = [name for name in (*METRICS, COMBINED) if name in values]
    return pairs.select("pair_id", "both_ran", *[values[name].alias(name) for name in ordered])


def metrics_long(metrics: DataFrame, keys: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per key and metric."""
    return metrics.unpivot(keys, list(names), "score_name", "score")


def result_fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, fingerprint)``: one value per result table that ignores row order and copies.

    Distinct rows are first spread over their keys, then folded with commutative aggregates,
    so no result is sorted or collected.
    """
    distinct = rows.select(*keys, row_key(F.col("cells")).alias("row_key")).distinct()
    mark = F.xxhash64("row_key")
    second = F.xxhash64(F.lit("second"), F.col("row_key"))
    return distinct.groupBy(*keys).agg(
        F.concat_ws(
            ":",
            F.count(F.lit(1)).cast("string"),
            F.sum(mark.cast("decimal(38,0)")).cast("string"),
            F.bit_xor(second).cast("string"),
        ).alias("fingerprint")
    )


def majority_vote(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """``(question_id, sample_idx, votes)``: the candidate whose result most candidates share.

    ``candidates(question_id, sample_idx, ok)`` lists every sample, ``rows(question_id,
    sample_idx, cells)`` their results. Failed samples do not vote; ties go to the group with
    the earliest sample. A question with failures only gets its first sample and 0 votes.
    """
    keys = ["question_id", "sample_idx"]
    marked = candidates.join(result_fingerprints(rows, keys), keys, "left")
    return vote(marked.select(*keys, F.when(F.col("ok"), F.coalesce("fingerprint", F.lit("0"))).alias("fingerprint")))


def vote(marked: DataFrame) -> DataFrame:
    """``(question_id, sample_idx, votes)`` from ``marked(question_id, sample_idx, fingerprint)``; null does not vote."""
    groups = marked.groupBy("question_id", "fingerprint").agg(
        F.count("fingerprint").alias("votes"), F.min("sample_idx").alias("first_idx")
    )
    best = F.max(F.struct(F.col("votes"), (-F.col("first_idx")).alias("late")))
    return groups.groupBy("question_id").agg(best.alias("best")).select(
        "question_id", (-F.col("best.late")).alias("sample_idx"), F.col("best.votes").alias("votes")
    )
