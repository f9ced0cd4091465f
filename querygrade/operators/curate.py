"""Filters, exclusion, mixing and label joins of question datasets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from querygrade.operators import sampling
from querygrade.sources.questions import read_split


def drop_bad_gold(questions: DataFrame, column: str = "sql_execution_time") -> DataFrame:
    """Drop questions whose gold query failed (time -1); a missing time is kept."""
    return questions.where(~F.col(column).eqNullSafe(F.lit(-1)))


def counted_filter(frame: DataFrame, condition: Column) -> tuple[DataFrame, Observation, Observation]:
    """The filtered frame and two observations, ``rows`` before and after, filled by its next action."""
    before, after = Observation(), Observation()
    count = F.count(F.lit(1)).alias("rows")
    return frame.observe(before, count).where(condition).observe(after, count), before, after


def save_filtered(frame: DataFrame, condition: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the rows that meet the condition and gives them back, with ``(step, rows)`` for ``before`` and ``after``.

    Both counts come from the one pass that writes the table.
    """
    kept, before, after = counted_filter(frame, condition)
    kept.write.mode("overwrite").parquet(path)
    spark = frame.sparkSession
    counts = [(step, seen.get["rows"]) for step, seen in (("before", before), ("after", after))]
    return spark.read.schema(frame.schema).parquet(path), spark.createDataFrame(counts, "step string, rows long")


def exclude_listed(questions: DataFrame, excluded: DataFrame, column: str = "SQL") -> DataFrame:
    """Drop questions whose query is on the list; a null query stays."""
    return questions.join(excluded.select(column), column, "left_anti")


def training_columns(questions: DataFrame) -> DataFrame:
    """Drop ``messages`` and call the gold query ``target_sql``, where these columns exist."""
    return questions.drop("messages").withColumnRenamed("SQL", "target_sql")


def replicate(frame: DataFrame, experiments: int) -> DataFrame:
    """Every row once per experiment number."""
    return frame.withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(experiments - 1))))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Parts one after the other; they must name the same columns."""
    for part in parts[1:]:
        if set(part.columns) != set(parts[0].columns):
            raise ValueError(f"parts differ in columns: {sorted(parts[0].columns)} and {sorted(part.columns)}")
    return reduce(DataFrame.unionByName, parts)


@dataclass
class MixturePart:
    """One dataset of a mixture: where it is, what to keep, and how much of it."""

    id: str
    config: str | None = None
    split: str = "train"
    columns: list[str] | None = None
    weight: float | None = 1.0


@dataclass
class Mixture:
    datasets: list[MixturePart] = field(default_factory=list)
    seed: int = 0
    test_split_size: float | None = None

    def __post_init__(self) -> None:
        named = [set(part.columns) for part in self.datasets if part.columns is not None]
        if any(columns != named[0] for columns in named):
            raise ValueError("all parts of a mixture must keep the same columns")


def mix(parts: list[tuple[DataFrame, float | None]], id_column: str, seed: int) -> DataFrame:
    """Subsample each part by its weight and put the parts together."""
    return union_all(sampling.subsample_parts(parts, id_column, seed))


def load_mixture(spark: SparkSession, mixture: Mixture, id_column: str) -> dict[str, DataFrame]:
    """``train`` and, when a test size is set, ``test``, each in seeded random order."""
    if not mixture.datasets:
        raise ValueError("a mixture needs at least one dataset")
    parts = []
    for part in mixture.datasets:
        frame = read_split(spark, part.id, part.config, part.split)
        parts.append((frame.select(*part.columns) if part.columns else frame, part.weight))
    mixed = mix(parts, id_column, mixture.seed)
    if mixture.test_split_size is None:
        return {"train": sampling.shuffled(mixed, id_column, mixture.seed)}
    splits = sampling.train_test_split(mixed, id_column, mixture.seed, mixture.test_split_size)
    return {name: sampling.shuffled(frame, id_column, mixture.seed) for name, frame in splits.items()}


def enrich_with_labels(questions: DataFrame, lineage: DataFrame, executions: DataFrame, key: str) -> DataFrame:
    """Questions with ``tbls_in_query``, ``cols_in_query`` and ``sql_execution_time`` (-1 after an error).

    ``lineage(key, table_name, column_name)`` is rolled up first; a query text bounds its names.
    """
    qualified = F.when(F.col("column_name").isNotNull(), F.concat_ws(".", "table_name", "column_name"))
    names = lineage.groupBy(key).agg(
        F.sort_array(F.collect_set("table_name")).alias("tbls_in_query"),
        F.sort_array(F.collect_set(qualified)).alias("cols_in_query"),
    )
    seconds = F.when(F.col("status") == "ok", F.col("elapsed_ms") / 1000.0).otherwise(-1.0)
    times = executions.select(key, seconds.alias("sql_execution_time"))
    return questions.join(names, key, "left").join(times, key, "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: must be empty before scores are trusted."""
    return left.join(right.select(*keys), keys, "left_anti")
