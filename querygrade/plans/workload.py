"""Run many SQL queries as Spark jobs, with time limits and with errors as data.

The driver only holds query texts, a few at a time. Every result is written by executors to
its own folder, so a lost executor or a second run replaces a result and never doubles it.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrade.functions.cells import canonical_cell, short_key
from querygrade.operators.cache import KEY, cache_misses, with_key

EXECUTION_SCHEMA = "hash_key string, status string, error_class string, elapsed_ms bigint, n_cols int"
RESULT_SCHEMA = "row_idx bigint, cells array<string>, hash_key string"
# Functions that reach outside the query.
_FORBIDDEN = re.compile(r"\b(java_method|reflect|try_reflect)\s*\(", re.IGNORECASE)
STATUS_BATCH = 1000
CANCEL_EVERY_S = 0.5


def as_subquery(sql: str) -> str:
    """The text as a subquery, where only a single query can stand: no command, no second statement."""
    return f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n) AS candidate"


def _cells(frame: DataFrame) -> DataFrame:
    positional = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    cells = F.array(*[canonical_cell(F.col(f.name), f.dataType) for f in positional.schema.fields])
    return positional.select(F.monotonically_increasing_id().alias("row_idx"), cells.alias("cells"))


def _error_class(error: Exception) -> str:
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition or type(error).__name__


def run_query(session: SparkSession, key: str, sql: str, timeout_s: float, results: str) -> tuple:
    """Run one query into ``results/hash_key=<key>`` and return its execution row."""
    context = session.sparkContext
    done, expired = threading.Event(), threading.Event()

    def watch() -> None:
        # Repeated: a cancel that comes before the query's next job finds nothing to stop.
        if not done.wait(timeout_s):
            expired.set()
            while not done.wait(CANCEL_EVERY_S):
                context.cancelJobsWithTag(key)

    start = time.perf_counter()
    context.addJobTag(key)
    threading.Thread(target=watch, daemon=True).start()
    n_cols = None
    try:
        if _FORBIDDEN.search(sql):
            raise PermissionError("function not allowed")
        frame = session.sql(as_subquery(sql))
        n_cols = len(frame.columns)
        _cells(frame).write.mode("overwrite").parquet(f"{results}/hash_key={key}")
        status, error_class = ("timeout", "TIME_LIMIT") if expired.is_set() else ("ok", None)
    except Exception as error:  # noqa: BLE001 - errors are data here
        status, error_class = ("timeout", "TIME_LIMIT") if expired.is_set() else ("error", _error_class(error))
    finally:
        done.set()
        context.removeJobTag(key)
    return key, status, error_class, int((time.perf_counter() - start) * 1000), n_cols


def _execution_rows(sessions: dict[str, SparkSession], pending: Iterator, results: str, parallel: int) -> Iterator[tuple]:
    """Execution rows as they finish; at most ``parallel`` queries are in hand at any time."""
    with ThreadPoolExecutor(parallel) as pool:
        running = set()
        for row in pending:
            if row.db_id not in sessions:
                yield row.hash_key, "error", "UNKNOWN_DATABASE", 0, None
                continue
            if len(running) >= parallel:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                yield from (future.result() for future in done)
            running.add(pool.submit(run_query, sessions[row.db_id], row.hash_key, row.sql, row.timeout_s, results))
        for future in running:
            yield future.result()


def run_workload(
    spark: SparkSession,
    workload: DataFrame,
    sessions: dict[str, SparkSession],
    folder: str,
    cache: DataFrame | None = None,
    parallel: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Run each distinct query of ``workload(db_id, sql, timeout_s)`` once.

    Returns ``executions(hash_key, status, error_class, elapsed_ms, n_rows, n_cols)`` and
    ``results(hash_key, row_idx, cells)``, both read from ``folder``. Queries whose key is in
    ``cache`` are skipped.
    """
    distinct = (
        with_key(workload)
        .groupBy(KEY, "db_id", "sql")
        .agg(F.max("timeout_s").alias("timeout_s"))
    )
    if cache is not None:
        distinct = cache_misses(distinct, cache)
    batch: list[tuple] = []

    def flush() -> None:
        if batch:
            spark.createDataFrame(batch, EXECUTION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/executions")
            batch.clear()

    for row in _execution_rows(sessions, distinct.toLocalIterator(), f"{folder}/results", parallel):
        batch.append(row)
        if len(batch) >= STATUS_BATCH:
            flush()
    flush()
    return read_executions(spark, folder), read_results(spark, folder)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except PySparkException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows of finished queries. A failed write leaves no rows: its folder has no committed file."""
    return _read(spark, f"{folder}/results", RESULT_SCHEMA)


def read_executions(spark: SparkSession, folder: str) -> DataFrame:
    """Execution rows with ``n_rows``, counted over all results at once. A query run again shows its best run."""
    best = F.min_by(F.struct("status", "error_class", "elapsed_ms", "n_cols"), F.struct(F.col("status") != "ok", "elapsed_ms"))
    runs = _read(spark, f"{folder}/executions", EXECUTION_SCHEMA).groupBy(KEY).agg(best.alias("run")).select(KEY, "run.*")
    counts = read_results(spark, folder).groupBy(KEY).agg(F.count(F.lit(1)).alias("counted"))
    n_rows = F.when(F.col("status") == "ok", F.coalesce("counted", F.lit(0)))
    return runs.join(counts, KEY, "left").withColumn("n_rows", n_rows).drop("counted")


def result_pairs(pairs: DataFrame, executions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs of ``compare_results`` for ``pairs(pair_id, db_id, gold_sql, pred_sql)``.

    The same result serves every pair that needs it; it was computed once.
    """
    both_sides = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.col(f"{name}_sql").alias("sql")) for name in ("pred", "gold")]))
    # One read of the pairs, not a union of two: Spark does not see that two unions are the same, and would shuffle the
    # result rows again for every use that the comparison makes of them.
    sides = with_key(pairs.select("pair_id", "db_id", both_sides.alias("s")).select("pair_id", "db_id", "s.side", "s.sql")).select(
        "pair_id", "side", short_key(F.col(KEY)).alias("_key")
    )
    ran = executions.select(short_key(F.col(KEY)).alias("_key"), (F.col("status") == "ok").alias("ok"))
    status = sides.join(ran, "_key", "left")
    ok = F.coalesce("ok", F.lit(False))
    both = status.groupBy("pair_id").agg(
        F.max((F.col("side") == "pred") & ok).alias("pred_ok"), F.max((F.col("side") == "gold") & ok).alias("gold_ok")
    )
    good = status.where("ok").select("pair_id", "side", "_key")
    rows = results.select(short_key(F.col(KEY)).alias("_key"), "row_idx", "cells")
    return good.join(rows, "_key").select("pair_id", "side", "row_idx", "cells"), both
