"""Registered queries of the executed workload: query shapes, statuses and scores."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from querygrade.operators.compare import compare_results
from querygrade.plans import workload
from querygrade.session import shared_dir
from querygrade.sources import databases
from querygrade.suite.inputs import rounded, table

# The same text runs here and in the check engine.
SHAPES = {
    "wl_cte_window_union": """
WITH shipped AS (SELECT l_suppkey, l_returnflag, SUM(l_quantity) AS units FROM lineitem GROUP BY l_suppkey, l_returnflag),
     placed AS (SELECT s.s_name, h.l_returnflag, h.units,
                       DENSE_RANK() OVER (PARTITION BY h.l_returnflag ORDER BY h.units DESC, h.l_suppkey) AS place
                FROM shipped h JOIN supplier s ON s.s_suppkey = h.l_suppkey)
SELECT s_name, l_returnflag, ROUND(units, 2) AS units FROM placed WHERE place <= 3
UNION ALL
SELECT 'everyone', l_returnflag, ROUND(SUM(units), 2) FROM shipped GROUP BY l_returnflag""",
    "wl_exists": """
SELECT o.o_orderkey, o.o_orderpriority FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 48 AND l.l_returnflag = 'R')""",
    "wl_distinct_topk": """
SELECT DISTINCT p.p_brand, "large".p_size FROM part p
JOIN (SELECT p_partkey, p_size FROM part WHERE p_size > 40) "large" ON "large".p_partkey = p.p_partkey
WHERE p.p_retailprice > 990 OR p.p_type LIKE 'EC%' ORDER BY p.p_brand DESC, "large".p_size LIMIT 7""",
    "wl_group_having": """
SELECT c.c_custkey, c.c_mktsegment, COUNT(DISTINCT o.o_orderpriority) AS priorities, COUNT(o.o_orderkey) AS placed
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus <> 'P'
GROUP BY c.c_custkey, c.c_mktsegment HAVING COUNT(DISTINCT o.o_orderpriority) > 3 OR COUNT(o.o_orderkey) = 0""",
    "wl_cross_scalar": """
SELECT p.p_partkey, k.sold_as, ROUND(p.p_retailprice * k.factor, 2) AS price,
       (SELECT MAX(l_extendedprice) FROM lineitem) AS dearest_line
FROM part p CROSS JOIN (SELECT 'single' AS sold_as, 1 AS factor UNION ALL SELECT 'dozen', 12) k WHERE p.p_size <> 7""",
    "wl_order_length": "SELECT c_name, c_mktsegment FROM customer ORDER BY LENGTH(c_mktsegment), c_custkey DESC LIMIT 4",
    "wl_cte_max": """
WITH fullest(ship_day, most) AS (SELECT CAST(l_shipdate AS DATE), MAX(l_quantity) FROM lineitem GROUP BY CAST(l_shipdate AS DATE))
SELECT COUNT(*) AS days, SUM(most) AS units FROM fullest WHERE most >= 49""",
    "wl_join_count": """
SELECT COUNT(*) AS n FROM "lineitem" INNER JOIN "orders" ON "lineitem"."l_orderkey" = "orders"."o_orderkey"
WHERE "orders"."o_orderpriority" = '2-HIGH' AND "lineitem"."l_returnflag" = 'N'""",
}


@lru_cache(maxsize=4)
def _session(application: str, sf_dir: str, spark):
    return databases.attach_database(spark, sf_dir)


def session(spark, sf_dir):
    return _session(spark.sparkContext.applicationId, sf_dir, spark)


def _shape(sql):
    return lambda spark, sf_dir: session(spark, sf_dir).sql(sql)


def segment_pairs(spark, sf_dir):
    """A gold and a candidate query per market segment; candidates go wrong in different ways."""
    segment = F.col("c_mktsegment")
    of = lambda head, tail="": F.concat(F.lit(f"{head} FROM customer WHERE c_mktsegment = '"), segment, F.lit(f"'{tail}"))
    gold = of("SELECT c_custkey, c_nationkey", " ORDER BY c_custkey")
    pred = (
        F.when(segment == "AUTOMOBILE", of("SELECT c_custkey, c_nationkey", " ORDER BY c_custkey DESC"))
        .when(segment == "BUILDING", of("SELECT c_custkey", ";"))
        .when(segment == "FURNITURE", of("SELECT c_custkey, missing"))
        .when(segment == "HOUSEHOLD", of("DELETE"))
        .otherwise(of("SELECT c_custkey, c_nationkey", " AND c_acctbal > 0 ORDER BY c_custkey"))
    )
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return segments.select(
        segment.alias("pair_id"), F.lit("sales").alias("db_id"), gold.alias("gold_sql"), pred.alias("pred_sql")
    )


def run_segments(spark, sf_dir):
    pairs = segment_pairs(spark, sf_dir)
    work = pairs.select("db_id", F.explode(F.array("gold_sql", "pred_sql")).alias("sql"), F.lit(500.0).alias("timeout_s"))
    folder = shared_dir(spark, "workload")
    return pairs, *workload.run_workload(spark, work, {"sales": session(spark, sf_dir)}, folder)


def workload_status(spark, sf_dir):
    pairs, executions, _ = run_segments(spark, sf_dir)
    sides = pairs.select(
        F.col("pair_id").alias("segment"), "db_id",
        F.explode(F.map_from_arrays(F.array(F.lit("gold"), F.lit("pred")), F.array("gold_sql", "pred_sql"))).alias("side", "sql"),
    )
    ran = executions.select("hash_key", "status", "n_rows", "n_cols")
    return workload.with_key(sides).join(ran, "hash_key").select("segment", "side", "status", "n_rows", "n_cols")


STATUS_SQL = """
SELECT c_mktsegment AS segment, 'gold' AS side, 'ok' AS status, count(*) AS n_rows, 2 AS n_cols FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 'pred', CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'error' ELSE 'ok' END,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN count(*) WHEN c_mktsegment = 'MACHINERY' THEN count(*) FILTER (c_acctbal > 0) END,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 2 WHEN c_mktsegment = 'BUILDING' THEN 1 END
FROM customer GROUP BY c_mktsegment
"""


def workload_scores(spark, sf_dir):
    pairs, executions, results = run_segments(spark, sf_dir)
    metrics = compare_results(*workload.result_pairs(pairs, executions, results))
    names = ["tuple_cardinality", "tuple_constraint", "tuple_order", "bird_ex", "ex"]
    return metrics.select(F.col("pair_id").alias("segment"), *[rounded(n).alias(n) for n in names])


SCORES_SQL = """
WITH s AS (SELECT c_mktsegment AS segment, (count(*) FILTER (c_acctbal > 0))::DOUBLE / count(*) AS share FROM customer GROUP BY 1)
SELECT segment,
  round(CASE segment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN share ELSE 0 END, 6) AS tuple_cardinality,
  round(CASE segment WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN share ELSE 0 END, 6) AS tuple_constraint,
  CASE segment WHEN 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0 END AS tuple_order,
  CASE segment WHEN 'AUTOMOBILE' THEN 1.0::DOUBLE ELSE 0.0 END AS bird_ex,
  CASE segment WHEN 'AUTOMOBILE' THEN 1.0::DOUBLE ELSE 0.0 END AS ex
FROM s
"""

QUERIES = {
    **{name: (_shape(sql), sql) for name, sql in SHAPES.items()},
    "workload_status": (workload_status, STATUS_SQL),
    "workload_scores": (workload_scores, SCORES_SQL),
}
