"""Length penalty within the answers of one prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the penalty.
CORRECT_ABOVE, SPREAD_FLOOR, LARGEST_PENALTY = 0.5, 0.2, 0.9


def length_statistics(answers: DataFrame, group: str, generations: int) -> DataFrame:
    """``(group, avg_length, spread)`` of the correct answers, for full groups with two or more of them."""
    correct_length = F.when(F.col("score") > CORRECT_ABOVE, F.col("length"))
    return (
        answers.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count(correct_length).alias("correct"),
            F.avg(correct_length).alias("avg_length"),
            F.stddev_samp(correct_length).alias("std_length"),
        )
        .where((F.col("members") >= generations) & (F.col("correct") >= 2))
        .select(group, "avg_length", F.greatest("std_length", F.col("avg_length") * SPREAD_FLOOR).alias("spread"))
    )


def penalise_length(answers: DataFrame, group: str, generations: int, strength: float = 0.1) -> DataFrame:
    """Adds ``penalty`` and ``penalised`` to answers that carry ``score`` and ``length``.

    Statistics are a map-side-combined aggregate joined back on the group, not a window, so a
    group with a large share of the rows is neither sorted nor held by one task. A group with
    fewer than ``generations`` answers, or fewer than two correct ones, keeps its scores.
    """
    stats = length_statistics(answers, group, generations)
    stats = stats.withColumnRenamed(group, "stats_of")
    joined = answers.join(stats, F.col(group).eqNullSafe(F.col("stats_of")), "left").drop("stats_of")
    z = F.try_divide(F.col("length") - F.col("avg_length"), F.col("spread"))
    penalty = F.when((F.col("score") > 0) & (z > 0), F.least(F.lit(LARGEST_PENALTY), z * strength)).otherwise(0.0)
    lowered = F.when(F.col("penalty") > 0, F.greatest(F.lit(0.0), F.col("score") - F.col("penalty")))
    return (
        joined.withColumn("penalty", penalty)
        .withColumn("penalised", lowered.otherwise(F.col("score")))
        .drop("spread", "avg_length")
    )


def penalty_statistics(answers: DataFrame, group: str, generations: int, strength: float = 0.1) -> DataFrame:
    """Per group: average length and spread of correct answers, mean of the applied penalties."""
    penalised = penalise_length(answers, group, generations, strength)
    applied = F.when(F.col("penalty") > 0, F.col("penalty"))
    means = penalised.groupBy(group).agg(F.coalesce(F.avg(applied), F.lit(0.0)).alias("mean_penalty"))
    means = means.withColumnRenamed(group, "means_of")
    return length_statistics(answers, group, generations).join(means, F.col(group).eqNullSafe(F.col("means_of"))).drop("means_of")
