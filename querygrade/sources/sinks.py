"""Where reports and run settings are written."""

from __future__ import annotations

import dataclasses
import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strategy_name(number_of_completions: int) -> str:
    return "greedy" if number_of_completions == 1 else "majority_voting"


def _stamped(frame: DataFrame, number_of_completions: int, run_date: str | None, job_id: str | None) -> DataFrame:
    return frame.withColumns(
        {
            "strategy": F.lit(strategy_name(number_of_completions)),
            "run_date": F.lit(run_date or datetime.date.today().isoformat()),
            "job_id": F.lit(job_id or os.environ.get("JOB_ID", "unknown_job")),
        }
    )


def save_report(
    report: DataFrame,
    folder: str,
    number_of_completions: int = 1,
    run_date: str | None = None,
    job_id: str | None = None,
    fmt: str = "json",
) -> None:
    """Write report rows under ``strategy=/run_date=/job_id=``. A second run of one job replaces its own part."""
    (
        _stamped(report, number_of_completions, run_date, job_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("strategy", "run_date", "job_id")
        .format(fmt)
        .save(f"{folder.rstrip('/')}/report")
    )


def save_settings(
    spark: SparkSession,
    settings: dict[str, object],
    folder: str,
    number_of_completions: int = 1,
    run_date: str | None = None,
    job_id: str | None = None,
) -> None:
    """Write one ``(name, json)`` record per settings object, beside the report."""
    plain = lambda value: dataclasses.asdict(value) if dataclasses.is_dataclass(value) else value
    rows = [(name, json.dumps(plain(value), default=str)) for name, value in settings.items()]
    frame = spark.createDataFrame(rows, "name string, json string")
    (
        _stamped(frame, number_of_completions, run_date, job_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("strategy", "run_date", "job_id")
        .json(f"{folder.rstrip('/')}/settings")
    )
