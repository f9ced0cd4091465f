"""Question files, named datasets and exclusion lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of a question record.
QUESTION_SCHEMA = (
    "question string, evidence string, schema string, db_id string, SQL string, "
    "sql_execution_time double, tbls_in_query array<string>, cols_in_query array<string>"
)


def read_questions(spark: SparkSession, path: str, schema: str | None = None, line_breaks: bool = False) -> DataFrame:
    """A JSON array file, a CSV file with header, or Parquet, by suffix. Give a schema to skip inference.

    A CSV file whose values hold line breaks needs ``line_breaks``; it is then read by one task, like a JSON array.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".csv"):
        return reader.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return reader.parquet(path)


def read_split(spark: SparkSession, name: str, config: str | None = None, split: str | None = "train") -> DataFrame:
    """A named dataset: a catalog table, or a Parquet folder with one folder per config.

    Rows are kept by the ``split`` column when there is one; as a partition column it prunes.
    """
    if "/" in name:
        frame = spark.read.parquet(f"{name.rstrip('/')}/{config}" if config else name)
    else:
        frame = spark.table(name)
        if config and "config" in frame.columns:
            frame = frame.where(F.col("config") == config)
    if split is not None and "split" in frame.columns:
        frame = frame.where(F.col("split") == split).drop("split")
    return frame


def read_exclusions(spark: SparkSession, path: str, column: str = "SQL") -> DataFrame:
    return read_questions(spark, path).select(column)
