"""Tables and columns of a query, read from Spark's own plan.

Exact for any query that Spark accepts: scan nodes of ``EXPLAIN FORMATTED`` list the file
location and, after column pruning, just the columns that are read.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrade.plans.workload import as_subquery
from querygrade.session import shared_dir

PLAN_BATCH = 1000
PLAN_SCHEMA = "query_id string, status string, plan string"


def explain(session: SparkSession, sql: str) -> tuple[str, str]:
    try:
        plan = session.sql("EXPLAIN FORMATTED " + as_subquery(sql)).first()[0]
    except PySparkException as error:
        return error.getCondition() or type(error).__name__, ""
    # A query that fails analysis still gets a plan text, which holds the error.
    return ("error", "") if plan.startswith("Error occurred") else ("ok", plan)


def plans_of(
    spark: SparkSession, queries: DataFrame, session: SparkSession, folder: str | None = None, parallel: int = 8
) -> DataFrame:
    """``(query_id, status, plan)`` of ``queries(query_id, sql)``.

    Planning is work of the driver, so texts pass it in batches, and each batch of plans is
    written to ``folder`` before the next is read.
    """
    folder = folder or shared_dir(spark, "plans")
    texts = queries.select(F.col("query_id").cast("string").alias("query_id"), "sql").toLocalIterator()
    spark.createDataFrame([], PLAN_SCHEMA).write.mode("overwrite").parquet(folder)
    with ThreadPoolExecutor(parallel) as pool:
        while batch := list(islice(texts, PLAN_BATCH)):
            rows = pool.map(lambda row: (row.query_id, *explain(session, row.sql)), batch)
            spark.createDataFrame(list(rows), PLAN_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(PLAN_SCHEMA).parquet(folder)


def lineage_of_plans(plans: DataFrame) -> DataFrame:
    """``(query_id, status, table_name, column_name)``; a query without scans keeps one row of nulls."""
    scan = r"(?m)^Location: \S+ \[(\S+?)[,\]][\s\S]*?^ReadSchema: (struct<.*>)$"
    matches = F.regexp_extract_all("plan", F.lit(scan), F.lit(0))
    scans = plans.select("query_id", "status", F.explode_outer(matches).alias("scan"))
    place = F.regexp_extract("scan", r"\[(\S+?)(?:\]|, |\.\.\.)", 1)
    table = F.regexp_replace(F.substring_index(place, "/", -1), r"\.parquet$", "")
    fields = F.regexp_extract_all(F.regexp_extract("scan", r"ReadSchema: struct<(.*)>", 1), F.lit(r"(?:^|,)([^:,<>()]+):"), F.lit(1))
    return (
        scans.select("query_id", "status", F.when(F.col("scan").isNotNull(), table).alias("table_name"), F.explode_outer(fields).alias("column_name"))
        .distinct()
    )
