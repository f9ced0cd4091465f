"""Means, spreads, summaries and wide reports of scores.

Input ``scores(dataset_name, model_name, number_of_completions, experiment, score_name,
score, ...)``; all roll-ups combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrade.functions import formats

RUN_KEYS = ["number_of_completions", "model_name", "dataset_name", "score_name"]


def experiment_means(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(keys or RUN_KEYS), "experiment").agg(F.avg("score").alias("mean_score"))


def summarise(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation over experiments, in percent; a single experiment has deviation 0."""
    keys = keys or RUN_KEYS
    return (
        experiment_means(scores, keys)
        .groupBy(*keys)
        .agg(
            F.round(F.avg("mean_score") * 100, 3).alias("score"),
            F.round(F.coalesce(F.stddev_samp("mean_score"), F.lit(0.0)) * 100, 3).alias("std"),
        )
    )


def leaderboard(summary: DataFrame) -> DataFrame:
    """Rank of each model within its dataset and metric."""
    order = Window.partitionBy("dataset_name", "score_name").orderBy(F.col("score").desc())
    return summary.withColumn("place", F.rank().over(order))


def wide_report(frame: DataFrame, key: str, model: str, experiments: int, values: dict[str, str]) -> DataFrame:
    """One row per key with a column ``<prefix>_<model>_<i>`` for each value column and experiment.

    ``values`` maps the prefix (``Pred``, ``SQL`` or a metric) to the column that fills it.
    """
    columns = [
        F.first(F.when(F.col("experiment") == i, F.col(column)), ignorenulls=True).alias(f"{prefix}_{model}_{i}")
        for prefix, column in values.items()
        for i in range(experiments)
    ]
    return frame.groupBy(key).agg(*columns)


def format_failures(answers: DataFrame, by: str, tag: str = "think", text: str = "text") -> DataFrame:
    """``(by, failed, answers, failed_share)``: answers that don't have the wanted form, per value of a column."""
    failed = formats.format_score(F.col(text), tag) == 0
    counts = answers.groupBy(by).agg(F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("answers"))
    return counts.withColumn("failed_share", F.col("failed") / F.col("answers"))
