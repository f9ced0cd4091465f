"""Registered queries of the result comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrade.operators.compare import COMBINED, METRICS, compare_results, majority_vote
from querygrade.suite import inputs

# The SQL twin computes each metric on its own from the two row sets.
METRIC_SQL = (
    "WITH "
    + inputs.PAIRS_SQL
    + """,
rk AS (SELECT pair_id, c1, c2, c3, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gold') AS nt,
              min(row_idx) FILTER (side = 'pred') AS fp, min(row_idx) FILTER (side = 'gold') AS ft
       FROM result_rows GROUP BY ALL),
r AS (SELECT pair_id, sum(np) AS p, sum(nt) AS t, count(*) FILTER (np > 0 AND nt > 0) AS shared,
             count(*) FILTER ((np > 0) <> (nt > 0)) AS odd, count(*) FILTER (np <> nt) AS uneven,
             count(*) FILTER (nt > 0) AS dt, count(*) FILTER (nt > 0 AND np = nt) AS et
      FROM rk GROUP BY pair_id),
cells AS (SELECT pair_id, side, unnest([c1, c2, c3]) AS v FROM result_rows),
ck AS (SELECT pair_id, v, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gold') AS nt
       FROM cells GROUP BY ALL),
c AS (SELECT pair_id, sum(np) AS p, sum(nt) AS t, sum(CASE WHEN nt > 0 THEN np ELSE 0 END) AS ph,
             sum(CASE WHEN np > 0 THEN nt ELSE 0 END) AS th FROM ck GROUP BY pair_id),
ranks AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY fp) AS a,
                 row_number() OVER (PARTITION BY pair_id ORDER BY ft) AS b FROM rk WHERE np > 0 AND nt > 0),
o AS (SELECT pair_id, count(*) AS n, sum(CAST((a - b) * (a - b) AS DOUBLE)) AS g FROM ranks GROUP BY pair_id),
j AS (SELECT e.pair_id, e.c_mktsegment, e.c_nationkey, e.pred_ok AND e.gold_ok AS ok, coalesce(r.p, 0) AS np, coalesce(r.t, 0) AS nt,
             r.shared, r.odd, r.uneven, r.dt, r.et, c.p AS cp, c.t AS ct, c.ph, c.th, o.n, o.g
      FROM executions e LEFT JOIN r USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN o USING (pair_id)),
m AS (SELECT pair_id, c_mktsegment, c_nationkey, ok,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE ph::DOUBLE / cp END AS cell_precision,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE th::DOUBLE / ct END AS cell_recall,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 ELSE least(np, nt)::DOUBLE / greatest(np, nt) END AS tuple_cardinality,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE et::DOUBLE / dt END AS tuple_constraint,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 OR shared = 0 THEN 0.0 WHEN n = 1 THEN 1.0
       ELSE (1 - 6 * g / (n::DOUBLE * (n::DOUBLE * n - 1)) + 1) / 2 END AS tuple_order,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE (odd = 0)::INT::DOUBLE END AS bird_ex,
  CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE (uneven = 0)::INT::DOUBLE END AS ex
  FROM j),
metrics AS (SELECT *, (cell_precision + cell_recall + tuple_cardinality) / 3 AS cp_cr_tc FROM m)
"""
)


def all_metrics(spark, sf_dir):
    return compare_results(inputs.result_rows(spark, sf_dir), inputs.executions(spark, sf_dir))


def _metric(name):
    def run(spark, sf_dir):
        metrics = compare_results(
            inputs.result_rows(spark, sf_dir),
            inputs.executions(spark, sf_dir),
            with_order=name == "tuple_order",
        )
        return metrics.select("pair_id", inputs.rounded(name).alias(name))

    return run, METRIC_SQL + f"SELECT pair_id, round({name}, 6) AS {name} FROM metrics"


def result_metrics(spark, sf_dir):
    metrics = all_metrics(spark, sf_dir)
    return metrics.select("pair_id", *[inputs.rounded(m).alias(m) for m in (*METRICS, COMBINED)])


def match_by_kind(spark, sf_dir):
    """Share of matching pairs per kind of perturbation."""
    metrics = all_metrics(spark, sf_dir)
    return metrics.groupBy((F.col("pair_id") % 6).alias("kind")).agg(
        F.count(F.lit(1)).alias("pairs"),
        *[inputs.rounded(F.avg(m)).alias(m) for m in METRICS],
    )


VOTE_SQL = """
WITH samples AS (SELECT c_custkey // 8 AS question_id, c_custkey % 8 AS sample_idx, c_custkey % 12 <> 5 AS ok FROM customer),
prints AS (SELECT o_custkey // 8 AS question_id, o_custkey % 8 AS sample_idx,
                  string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS fp FROM orders GROUP BY ALL),
marked AS (SELECT question_id, sample_idx, CASE WHEN ok THEN coalesce(fp, '') END AS fp
           FROM samples LEFT JOIN prints USING (question_id, sample_idx)),
g AS (SELECT question_id, fp, count(fp) AS votes, min(sample_idx) AS first_idx FROM marked GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_idx) AS rn FROM g)
SELECT question_id, first_idx AS sample_idx, votes FROM ranked WHERE rn = 1
"""


def vote(spark, sf_dir):
    question, sample = (lambda c: F.expr(f"{c} DIV 8")), (lambda c: F.col(c) % 8)
    candidates = inputs.table(spark, sf_dir, "customer").select(
        question("c_custkey").alias("question_id"),
        sample("c_custkey").alias("sample_idx"),
        (F.col("c_custkey") % 12 != 5).alias("ok"),
    )
    rows = inputs.table(spark, sf_dir, "orders").select(
        question("o_custkey").alias("question_id"),
        sample("o_custkey").alias("sample_idx"),
        F.array("o_orderpriority").alias("cells"),
    )
    return majority_vote(candidates, rows)


_names = (*METRICS, COMBINED)
QUERIES = {
    **{name: _metric(name) for name in _names},
    "result_metrics": (
        result_metrics,
        METRIC_SQL + "SELECT pair_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _names) + " FROM metrics",
    ),
    "match_by_kind": (
        match_by_kind,
        METRIC_SQL
        + "SELECT pair_id % 6 AS kind, count(*) AS pairs, "
        + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
        + " FROM metrics GROUP BY 1",
    ),
    "majority_vote": (vote, VOTE_SQL),
}
