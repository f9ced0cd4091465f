"""Cache tables spread over many Parquet files."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrade.operators.cache import new_rows


def read_cache_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All cache rows under ``root``, with ``source_path`` and the row's place in its file.

    Files with an excluded name are left out. Columns that a file lacks are null.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .option("mergeSchema", True)
        .parquet(root)
        .select(
            "*",
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.row_index").alias("row_rank"),
        )
    )
    return rows.where(~F.col("file_name").isin(*excluded)).drop("file_name") if excluded else rows.drop("file_name")


def append_to_cache(spark: SparkSession, rows: DataFrame, path: str, order: str = "row_rank") -> None:
    """Append the rows whose key the cache at ``path`` does not hold, first row per key.

    Running it again with the same rows appends nothing, but for rows without a key: they never conflict.
    """
    try:
        known = spark.read.parquet(path)
    except PySparkException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = rows.where(F.lit(False))
    new_rows(rows, known, order).write.mode("append").parquet(path)
