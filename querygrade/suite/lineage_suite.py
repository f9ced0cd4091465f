"""Registered queries of lineage: a log with one query text per order, in nine shapes.

The expected answer is stated per shape, so the check does not repeat the method.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrade.operators import curate, lineage
from querygrade.plans import plan_lineage
from querygrade.sources import databases
from querygrade.suite.inputs import rounded, table
from querygrade.suite.workload_suite import session

SHAPES = [
    "SELECT c.c_name, o.o_totalprice FROM customer AS c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = {k}",
    "WITH big AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)\n"
    "SELECT o_orderdate, big.q FROM orders JOIN big ON big.l_orderkey = orders.o_orderkey WHERE o_orderkey > {k} -- from part\n",
    "SELECT * FROM part p, supplier AS s WHERE p.p_partkey = {k} AND s.s_name LIKE 'from nation n'",
    'SELECT n.*, r_name FROM "nation" n LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < {k}',
    "SELECT COUNT(o_comment) FROM ORDERS WHERE O_ORDERPRIORITY = '{p}' AND o_orderkey <> {k}",
    "SELECT p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = part.p_partkey AND l.l_quantity > {k})\n"
    "UNION ALL SELECT s_name FROM supplier /* join customer */",
    "SELECT x.o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey = {k}) AS x JOIN missing m ON m.id = x.o_orderkey",
    "SELECT x.key, n_name FROM (SELECT s_nationkey AS key FROM supplier WHERE s_suppkey IN (1, ABS({k}))) x, nation n WHERE x.key = n.n_nationkey",
    'SELECT so."order key", `Total price` FROM "Sales orders" AS so JOIN customer ON c_custkey = so."cust key" WHERE "order key" = {k}',
]

# What a reader of each shape would answer.
COLUMNS = {
    0: {"customer": ["c_name", "c_custkey"], "orders": ["o_totalprice", "o_custkey", "o_orderkey"]},
    1: {"lineitem": ["l_orderkey", "l_quantity"], "orders": ["o_orderdate", "o_orderkey"]},
    2: {"part": ["p_partkey"], "supplier": ["s_name"]},
    3: {"nation": ["n_regionkey"], "region": ["r_name", "r_regionkey"]},
    4: {"orders": ["o_orderpriority", "o_orderkey"]},
    5: {"part": ["p_name", "p_partkey"], "lineitem": ["l_partkey", "l_quantity"], "supplier": ["s_name"]},
    6: {"orders": ["o_orderkey"]},
    7: {"supplier": ["s_nationkey", "s_suppkey"], "nation": ["n_name", "n_nationkey"]},
    8: {"Sales orders": ["order key", "Total price", "cust key"], "customer": ["c_custkey"]},
}
STARS = {2: [None], 3: ["nation"]}


def query_log(spark, sf_dir):
    n = len(SHAPES)
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    text = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("o_orderkey") % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.replace(F.replace(text, F.lit("{k}"), key), F.lit("{p}"), priority).alias("sql")
    )


# A table of the catalog whose names are more than one word.
WIDE_TABLE = ("sales", "Sales orders", ["order key", "cust key", "Total price"])


def catalog(spark, sf_dir):
    tables = databases.catalog_tables(databases.catalog_rows(spark, {"sales": sf_dir}))
    return tables.unionByName(spark.createDataFrame([WIDE_TABLE], tables.schema))


def _row_sql(row):
    return "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")"


def _expected_sql(rows, columns):
    values = ", ".join(map(_row_sql, rows))
    names = ", ".join(columns)
    return f"WITH e(shape, {names}) AS (VALUES {values}) SELECT o_orderkey AS query_id, {names} FROM orders JOIN e ON shape = o_orderkey % {len(SHAPES)}"


_TABLE_ROWS = [(shape, name) for shape, tables in COLUMNS.items() for name in tables]
_COLUMN_ROWS = [(s, t, c) for s, tables in COLUMNS.items() for t, columns in tables.items() for c in columns]
_STAR_ROWS = [(s, t, c) for s, t, c in _COLUMN_ROWS if t not in STARS.get(s, [])] + [
    (s, name, "*") for s, names in STARS.items() for name in names
]


def enrich_labels(spark, sf_dir):
    log = query_log(spark, sf_dir)
    ran = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"),
        F.col("o_totalprice").alias("elapsed_ms"),
    )
    labelled = curate.enrich_with_labels(log, lineage.used_columns(log, catalog(spark, sf_dir)), ran, "query_id")
    return labelled.select(
        "query_id",
        F.array_join("tbls_in_query", ",").alias("tbls_in_query"),
        F.array_join("cols_in_query", ",").alias("cols_in_query"),
        rounded("sql_execution_time").alias("sql_execution_time"),
    )


ENRICH_SQL = (
    _expected_sql(_COLUMN_ROWS, ["table_name", "column_name"]).replace("SELECT o_orderkey", "SELECT o_orderstatus, o_totalprice, o_orderkey").replace(
        "WITH e", "WITH rows_ AS (WITH e"
    )
    + """)
SELECT query_id, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tbls_in_query,
       string_agg(table_name || '.' || column_name, ',' ORDER BY table_name || '.' || column_name) AS cols_in_query,
       round(CASE WHEN any_value(o_orderstatus) = 'P' THEN -1.0 ELSE any_value(o_totalprice) / 1000 END, 6) AS sql_execution_time
FROM rows_ GROUP BY query_id"""
)

# --- lineage by plan: the log's distinct shapes are explained once, and counted ----------------

_NUMBER_OR_TEXT = r"'[^']*'|\b\d+\b"


def lineage_plan(spark, sf_dir):
    """Columns each shape of the log reads after pruning, with the number of log rows of that shape."""
    shape = F.regexp_replace("sql", _NUMBER_OR_TEXT, "0").alias("shape")
    shapes = query_log(spark, sf_dir).select("query_id", "sql", shape).groupBy(F.md5("shape").alias("shape_key")).agg(
        F.count(F.lit(1)).alias("n_queries"), F.min_by("sql", "query_id").alias("sql"), F.min("query_id").alias("first_query")
    )
    texts = shapes.select(F.col("shape_key").alias("query_id"), "sql")
    plans = plan_lineage.plans_of(spark, texts, session(spark, sf_dir))
    found = plan_lineage.lineage_of_plans(plans).withColumnRenamed("query_id", "shape_key")
    return found.join(shapes.select("shape_key", "n_queries", "first_query"), "shape_key").select(
        "first_query", "n_queries", "status", "table_name", "column_name"
    )


# A star reads every column; the three shapes that name what is not there have no plan.
_ALL_READ = {
    2: {"part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(), "supplier": "s_suppkey s_name s_nationkey s_acctbal".split()},
    3: {"nation": "n_nationkey n_name n_regionkey".split(), "region": ["r_name", "r_regionkey"]},
    4: {},
    6: {},
    8: {},
}
_PLAN_ROWS = [
    row
    for shape in COLUMNS
    for row in [(shape, "ok", t, c) for t, columns in _ALL_READ.get(shape, COLUMNS[shape]).items() for c in columns]
    or [(shape, "error", None, None)]
]
PLAN_SQL = (
    f"WITH n AS (SELECT o_orderkey % {len(SHAPES)} AS shape, count(*) AS n_queries, min(o_orderkey) AS first_query FROM orders GROUP BY 1), "
    f"e(shape, status, table_name, column_name) AS (VALUES {', '.join(_row_sql(row) for row in _PLAN_ROWS)}) "
    "SELECT first_query, n_queries, status, table_name, column_name FROM n JOIN e USING (shape)"
)

QUERIES = {
    "lineage_tables": (
        lambda spark, sf_dir: lineage.used_tables(query_log(spark, sf_dir), catalog(spark, sf_dir)),
        _expected_sql(_TABLE_ROWS, ["table_name"]),
    ),
    "lineage_columns": (
        lambda spark, sf_dir: lineage.used_columns(query_log(spark, sf_dir), catalog(spark, sf_dir)),
        _expected_sql(_COLUMN_ROWS, ["table_name", "column_name"]),
    ),
    "lineage_no_cte": (
        lambda spark, sf_dir: lineage.mentioned_tables(query_log(spark, sf_dir)),
        _expected_sql([*[(s, t.lower()) for s, t in _TABLE_ROWS], (6, "missing")], ["table_name"]),
    ),
    "lineage_star": (
        lambda spark, sf_dir: lineage.used_columns_with_stars(query_log(spark, sf_dir), catalog(spark, sf_dir)),
        _expected_sql(_STAR_ROWS, ["table_name", "column_name"]),
    ),
    "enrich_labels": (enrich_labels, ENRICH_SQL),
    "lineage_plan": (lineage_plan, PLAN_SQL),
}
