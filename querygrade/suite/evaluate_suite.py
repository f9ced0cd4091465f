"""Registered queries of the evaluation from stored results: one question per customer, answered in one of six ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.functions.cells import query_key
from querygrade.operators.compare import COMBINED, METRICS
from querygrade.plans.evaluate import evaluate_results, prediction_pairs
from querygrade.session import shared_dir
from querygrade.suite import inputs
from querygrade.suite.compare_suite import METRIC_SQL
from querygrade.suite.curate_suite import SCORES_SQL

DATABASE = "sales"


def _gold_sql(customer):
    return F.concat(F.lit("SELECT o_orderpriority, o_orderstatus, floor(o_totalprice / 100000) FROM orders WHERE o_custkey = "), customer.cast("string"))


def _pred_sql(customer):
    """The same text if the answer is right, else one of its own."""
    return F.when(customer % 6 == 0, _gold_sql(customer)).otherwise(F.concat(_gold_sql(customer), F.lit(" AND "), (customer % 6).cast("string")))


def questions(spark, sf_dir):
    customer = F.col("c_custkey")
    return inputs.table(spark, sf_dir, "customer").select(
        customer.alias("question_id"), F.lit(DATABASE).alias("db_id"), _gold_sql(customer).alias("SQL"), F.lit(1.0).alias("sql_execution_time")
    )


def predictions(spark, sf_dir):
    customer = F.col("c_custkey")
    return inputs.table(spark, sf_dir, "customer").select(
        customer.alias("question_id"),
        (F.col("c_nationkey") % 3).alias("experiment"),
        F.lit(0).alias("sample_idx"),
        F.concat(F.lit("model_"), (customer % 2).cast("string")).alias("model_name"),
        F.col("c_mktsegment").alias("dataset_name"),
        F.concat(F.lit("<answer>\n"), _pred_sql(customer), F.lit("\n</answer>")).alias("text"),
    )


def stored_results(spark, sf_dir, side_by_side=False):
    """Executions and result rows of all gold and predicted queries; a run leaves the rows of a result side by side."""
    pair, is_pred = F.col("pair_id"), F.col("side") == "pred"
    key = lambda sql: query_key(F.lit(DATABASE), sql).alias("hash_key")
    rows = inputs.result_rows(spark, sf_dir).where(~is_pred | (pair % 6 != 0))
    if side_by_side:
        rows = rows.repartition("pair_id", "side").sortWithinPartitions("pair_id", "side")
    results = rows.select(key(F.when(is_pred, _pred_sql(pair)).otherwise(_gold_sql(pair))), "row_idx", "cells")
    ran = inputs.executions(spark, sf_dir)
    status = lambda ok: F.when(ok, "ok").otherwise("error").alias("status")
    gold = ran.select(key(_gold_sql(pair)), status(F.col("gold_ok")))
    pred = ran.where(pair % 6 != 0).select(key(_pred_sql(pair)), status(F.col("pred_ok")))
    return gold.unionByName(pred), results


def _saved(store, label):
    path = shared_dir(store.sparkSession, label)
    store.write.parquet(path)
    return store.sparkSession.read.parquet(path)


def evaluate_stored(spark, sf_dir):
    """The same evaluation with no store, with one in which pairs are missing or have other results, and with a whole one."""
    asked, answered = questions(spark, sf_dir), predictions(spark, sf_dir)
    executions, results = (_saved(frame, name) for frame, name in zip(stored_results(spark, sf_dir, side_by_side=True), ("executions", "results")))
    some = inputs.table(spark, sf_dir, "customer").where("c_custkey % 2 = 1 AND c_nationkey > 4").select(F.col("c_custkey").alias("question_id"))
    then = results.withColumn("cells", F.when(F.col("row_idx") < 0, F.reverse("cells")).otherwise(F.col("cells")))  # the reversed answers were others
    earlier = evaluate_results(asked, answered.join(some, "question_id", "left_semi"), executions, then)
    evaluated = lambda store, name: _saved(evaluate_results(asked, answered, executions, results, store=store).store, name)
    stores = {"none": evaluated(None, "none"), "partial": evaluated(_saved(earlier.store, "earlier"), "partial")}
    stores["whole"] = evaluated(stores["partial"], "whole")
    pairs = prediction_pairs(asked, answered).select("question_id", "pair_id")
    found = reduce(DataFrame.unionByName, [frame.withColumn("store", F.lit(name)) for name, frame in stores.items()])
    return pairs.join(found, "pair_id").select("question_id", "store", "fresh", *[inputs.rounded(m).alias(m) for m in (*METRICS, COMBINED)])


_names = (*METRICS, COMBINED)
EVALUATE_SQL = (
    METRIC_SQL
    + f"""SELECT pair_id AS question_id, store, CASE store WHEN 'none' THEN TRUE WHEN 'whole' THEN FALSE
  ELSE pair_id % 2 = 0 OR c_nationkey <= 4 OR (pair_id % 6 = 1 AND pair_id IN (SELECT o_custkey FROM orders)) END AS fresh,
  {", ".join(f"round({m}, 6) AS {m}" for m in _names)} FROM metrics, (VALUES ('none'), ('partial'), ('whole')) AS v(store)"""
)


def evaluate_summary(spark, sf_dir):
    executions, results = stored_results(spark, sf_dir)
    return evaluate_results(questions(spark, sf_dir), predictions(spark, sf_dir), executions, results).summary


QUERIES = {
    "evaluate_stored": (evaluate_stored, EVALUATE_SQL),
    "evaluate_summary": (evaluate_summary, SCORES_SQL + "SELECT * FROM summary"),
}
