"""Evaluation of saved predictions: answer text in, summary and wide report out.

Scores of result pairs can be stored with a fingerprint of both results, so that the next evaluation compares only
the pairs whose results have changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrade.functions.cells import query_key, short_key
from querygrade.functions.text import extract_sql, short_dataset_name, short_model_name, time_limit
from querygrade.operators.compare import COMBINED, METRICS, compare_results, metrics_long, result_fingerprints, vote
from querygrade.operators.cache import KEY, with_key
from querygrade.operators.curate import drop_bad_gold, unmatched
from querygrade.operators.report import summarise, wide_report
from querygrade.plans.workload import result_pairs, run_workload
from querygrade.session import shared_dir

GOLD_SECONDS = 500.0
KEYS = ["question_id", "experiment", "sample_idx", "model_name", "dataset_name"]


@dataclass
class Evaluation:
    """Frames of one evaluation; all are lazy but the executed results.

    ``lone_predictions`` and ``lone_questions`` have no partner and no score: look at them before trusting the rest.
    ``store`` has the metrics of every pair of queries with its fingerprint, and whether it was compared (``fresh``)
    or taken from the store of an earlier evaluation; save it for the next one.
    """

    executions: DataFrame
    metrics: DataFrame
    scores: DataFrame
    summary: DataFrame
    lone_predictions: DataFrame
    lone_questions: DataFrame
    store: DataFrame

    def report(self, model: str, experiments: int) -> DataFrame:
        """One row per question with prediction, SQL and metrics of each experiment; ``sources.sinks.save_report`` saves it."""
        values = {"Pred": "text", "SQL": "pred_sql", **{name: name for name in METRICS}}
        return wide_report(self.metrics, "question_id", model, experiments, values)


def _gold(questions: DataFrame) -> DataFrame:
    return drop_bad_gold(questions).select("question_id", "db_id", F.col("SQL").alias("gold_sql"))


def prediction_pairs(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every prediction that has a question, with both queries; ``pair_id`` names the two queries, not the prediction."""
    pred_sql = extract_sql(F.col("text"))
    found = predictions.join(_gold(questions), "question_id").select(*KEYS, "db_id", "gold_sql", "text", pred_sql.alias("pred_sql"))
    return found.withColumn("pair_id", short_key(F.sha2(F.to_json(F.struct("db_id", "gold_sql", "pred_sql")), 256)))


def _voted(pairs: DataFrame, rows: DataFrame, ran: DataFrame) -> DataFrame:
    """The prediction that wins the majority vote of its question and experiment."""
    group = F.sha2(F.to_json(F.struct("question_id", "experiment", "model_name", "dataset_name")), 256)
    prints = result_fingerprints(rows.where(F.col("side") == "pred"), ["pair_id"])
    marked = pairs.withColumn("group", group).join(ran, "pair_id").join(prints, "pair_id", "left")
    mark = F.when(F.col("pred_ok"), F.coalesce("fingerprint", F.lit("0"))).alias("fingerprint")
    winners = vote(marked.select(F.col("group").alias("question_id"), "sample_idx", mark)).withColumnRenamed("question_id", "group")
    return pairs.withColumn("group", group).join(winners, ["group", "sample_idx"], "left_semi").drop("group")


def result_prints(results: DataFrame) -> DataFrame:
    """``(hash_key, print)``: changes with any row, cell or position of a result. One pass with map-side combining."""
    place = F.struct("row_idx", "cells")
    return results.groupBy(KEY).agg(
        F.concat_ws(
            ":",
            F.count(F.lit(1)).cast("string"),
            F.sum(F.xxhash64(place).cast("decimal(38,0)")).cast("string"),
            F.bit_xor(F.xxhash64(F.lit("second"), place)).cast("string"),
        ).alias("print")
    )


def pair_prints(pairs: DataFrame, executions: DataFrame, results: DataFrame) -> DataFrame:
    """``(pair_id, print)`` of ``pairs(pair_id, db_id, gold_sql, pred_sql)``: what the metrics of a pair are made of.

    Each result is read once, however many pairs use it. A query that failed or was never run has no result.
    """
    brief = lambda frame: frame.withColumn(KEY, short_key(F.col(KEY)))
    state = brief(executions).join(result_prints(brief(results)), KEY, "left")
    said = F.when(F.col("status") == "ok", F.coalesce("print", F.lit("0"))).otherwise("failed")
    state = state.select(KEY, said.alias("print"))
    key = lambda side: short_key(query_key(F.col("db_id"), F.col(f"{side}_sql"))).alias(f"{side}_key")
    named = pairs.select("pair_id", key("gold"), key("pred"))
    for side in ("gold", "pred"):
        own = state.select(F.col(KEY).alias(f"{side}_key"), F.col("print").alias(f"{side}_print"))
        found = named.join(own, f"{side}_key", "left").drop(f"{side}_key")
        named = found.withColumn(f"{side}_print", F.coalesce(f"{side}_print", F.lit("failed")))
    return named.select("pair_id", F.concat_ws("|", "gold_print", "pred_print").alias("print"))


def compare_with_store(pairs: DataFrame, executions: DataFrame, results: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """All metrics of ``pairs``, with ``print`` and ``fresh``; pairs whose print is in the store are not compared.

    A store without rows and none at all are the same. Entries of the store that no pair has are left out.
    """
    prints = pair_prints(pairs, executions, results)
    kept = None
    if store is not None:
        kept = store.select("pair_id", "print", "both_ran", *METRICS, COMBINED).dropDuplicates(["pair_id", "print"])
        pairs = pairs.join(prints.join(kept, ["pair_id", "print"], "left_anti").select("pair_id"), "pair_id", "left_semi")
        kept = prints.join(kept, ["pair_id", "print"]).withColumn("fresh", F.lit(False))
    fresh = compare_results(*result_pairs(pairs, executions, results)).join(prints, "pair_id").withColumn("fresh", F.lit(True))
    return fresh if kept is None else fresh.unionByName(kept)


def evaluate_results(
    questions: DataFrame,
    predictions: DataFrame,
    executions: DataFrame,
    results: DataFrame,
    number_of_completions: int = 1,
    store: DataFrame | None = None,
) -> Evaluation:
    """Score predictions from stored executions and result rows; nothing is run.

    Inputs are those of ``evaluate_predictions``, plus ``executions(hash_key, status)`` and
    ``results(hash_key, row_idx, cells)`` of any run. Each pair of different queries is compared once, however
    many predictions made it, and not at all if ``store``, the ``store`` of an earlier evaluation, has it with the
    same results. A query without a stored execution counts as failed.
    """
    pairs = prediction_pairs(questions, predictions)
    # The id is made of the other three. No aggregate of first values, which Spark would not see to be the same when used twice.
    distinct = pairs.select("pair_id", "db_id", "gold_sql", "pred_sql").distinct()
    compared = compare_with_store(distinct, executions, results, store)
    chosen = _voted(pairs, *result_pairs(distinct, executions, results)) if number_of_completions > 1 else pairs
    metrics = compared.drop("print", "fresh").join(chosen, "pair_id")
    scores = metrics_long(metrics, KEYS, METRICS).select(
        "question_id",
        "experiment",
        "sample_idx",
        short_model_name(F.col("model_name")).alias("model_name"),
        short_dataset_name(F.col("dataset_name")).alias("dataset_name"),
        F.lit(number_of_completions).alias("number_of_completions"),
        "score_name",
        "score",
    )
    gold = _gold(questions)
    lone = unmatched(predictions, gold, ["question_id"]), unmatched(gold, predictions, ["question_id"])
    return Evaluation(executions, metrics, scores, summarise(scores), *lone, compared)


def evaluate_predictions(
    spark: SparkSession,
    questions: DataFrame,
    predictions: DataFrame,
    sessions: dict[str, SparkSession],
    number_of_completions: int = 1,
    folder: str | None = None,
    cache: tuple[DataFrame, DataFrame] | None = None,
) -> Evaluation:
    """Score ``predictions(question_id, experiment, sample_idx, model_name, dataset_name, text)``.

    ``questions(question_id, db_id, SQL, sql_execution_time)`` are the gold side. Every
    distinct query runs once, and all metrics come from those results. With several
    completions, only the sample that wins the majority vote of its question is scored.
    ``cache`` holds the executions and result rows of earlier runs: their queries are not run
    again, and their stored rows are scored.
    """
    pairs = prediction_pairs(questions, predictions)
    limit = time_limit(F.lit(GOLD_SECONDS)).alias("timeout_s")
    work = pairs.select("db_id", F.explode(F.array("gold_sql", "pred_sql")).alias("sql"), limit)
    known = cache[0] if cache else None
    executions, results = run_workload(spark, work, sessions, folder or shared_dir(spark, "evaluation"), known)
    if cache:
        needed = with_key(work).select(KEY).distinct()
        executions = executions.unionByName(cache[0].join(needed, KEY, "left_semi"))
        results = results.unionByName(cache[1].join(needed, KEY, "left_semi"))
    return evaluate_results(questions, predictions, executions, results, number_of_completions)
