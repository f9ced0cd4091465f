"""Inputs that the registered queries derive from the given tables.

Each builder has a twin in SQL (the ``*_SQL`` texts), so a check engine can start from the
same rows. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygrade.functions.cells import canonical_cell


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- answers: one model answer per document, in nine shapes ---------------------------------

GENERATIONS = 8
_SHAPES = [
    "'<think>\n' || text || '\n</think>\n<answer>\n' || sql || '\n</answer>'",
    "'<reasoning>\n' || text || '\n</reasoning>\n<answer>\n```sql\n' || sql || '\n```\n</answer>'",
    "'<think>\n' || text || '\n</think>\n<answer>\n' || sql",
    "'<think>\n' || text || '\n</think>\n<answer>\n' || sql || '\n</answer>\n<answer>\n' || sql || '\n</answer>'",
    "'<answer>\n' || sql || '\n</answer>\n<reasoning>\n' || text || '\n</reasoning>'",
    "'  <reasoning>\n' || text || '\n</reasoning>\n\n<tables>\norders, `customer`\n</tables>\n<columns>\n"
    "orders.o_orderkey, orders.`o_custkey`\n</columns>\n<checks>\nread only\n</checks>\n<answer>\n' || sql || "
    "'\n</answer>\n'",
    "text",
    "text || '\n```sql\nSELECT 0\n```\n```sql\n' || sql || '\n```'",
    "'<THINK>' || text || '</THINK><answer>\n{\"sql\": \"' || sql || '\"}\n</answer>'",
]
_SQL_OF_DOC = "'SELECT o_orderkey FROM orders WHERE o_custkey = ' || CAST(doc_id AS {string})"
_SHAPE_CASE = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"

ANSWERS_SQL = (
    "queried AS (SELECT doc_id, lang, source, text, " + _SQL_OF_DOC.format(string="VARCHAR") + " AS sql FROM documents), "
    "answers AS (SELECT q.doc_id, q.doc_id // 8 AS prompt_id, q.lang, q.source, q.text AS body, q.sql AS sql, "
    + _SHAPE_CASE.replace("doc_id", "q.doc_id").replace("|| text", "|| q.text").replace("THEN text", "THEN q.text").replace("|| sql", "|| q.sql")
    + " AS text, COALESCE(CAST(l.quality AS DOUBLE), 0.0) AS score, (l.toxic IS NULL OR l.toxic = 0) AS both_ran "
    "FROM queried q LEFT JOIN labels l ON l.doc_id = q.doc_id)"
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, prompt_id, lang, source, body, sql, text)``."""
    return answers_of(documents(spark, sf_dir))


def answers_of(documents: DataFrame) -> DataFrame:
    """The same from any frame of documents, also a stream."""
    documents = documents.withColumn("sql", F.expr(_SQL_OF_DOC.format(string="STRING")))
    return documents.select(
        "doc_id",
        F.expr(f"doc_id DIV {GENERATIONS}").alias("prompt_id"),
        "lang",
        "source",
        F.col("text").alias("body"),
        "sql",
        F.expr(_SHAPE_CASE.replace("\n", "\\n")).alias("text"),
    )


def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers`` with a score from the quality label and ``both_ran`` from the toxic label."""
    labels = table(spark, sf_dir, "labels")
    return (
        answers(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .withColumn("score", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)))
        .withColumn("both_ran", F.col("toxic").isNull() | (F.col("toxic") == 0))
        .drop("quality", "toxic")
    )


# --- result pairs: one question per customer, its orders as the gold rows --------------------

PAIRS_SQL = """
gold_rows AS (
  SELECT o_custkey AS pair_id, 'gold' AS side, o_orderkey AS row_idx, o_orderpriority AS c1, o_orderstatus AS c2,
         CAST(floor(o_totalprice / 100000) AS VARCHAR) AS c3
  FROM orders),
pred_rows AS (
  SELECT pair_id, 'pred' AS side,
         CASE pair_id % 6 WHEN 1 THEN -row_idx WHEN 3 THEN row_idx * 2 + copy ELSE row_idx END AS row_idx,
         CASE WHEN pair_id % 6 = 4 AND c1 = '1-URGENT' THEN 'changed' ELSE c1 END AS c1, c2, c3
  FROM gold_rows, (VALUES (0), (1)) AS copies(copy)
  WHERE (copy = 0 OR pair_id % 6 = 3) AND NOT (pair_id % 6 = 2 AND c2 = 'F') AND pair_id % 6 <> 5),
result_rows AS (SELECT * FROM gold_rows UNION ALL SELECT * FROM pred_rows),
executions AS (
  SELECT c_custkey AS pair_id, c_custkey % 12 <> 5 AS pred_ok, TRUE AS gold_ok, c_mktsegment, c_nationkey FROM customer)
"""


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows of every customer and a prediction that differs by kind.

    Kinds by key: same, reversed, rows of one status lost, doubled, one cell changed, none.
    """
    kind = F.col("pair_id") % 6
    bucket = canonical_cell(F.floor(F.col("o_totalprice") / 100000), T.LongType())
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    gold = orders.select(
        F.col("o_custkey").alias("pair_id"),
        F.lit("gold").alias("side"),
        F.col("o_orderkey").alias("row_idx"),
        F.array("o_orderpriority", "o_orderstatus", bucket).alias("cells"),
    )
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = F.when((kind == 4) & (F.col("cells")[0] == "1-URGENT"), F.lit("changed")).otherwise(F.col("cells")[0])
    position = F.when(kind == 1, -F.col("row_idx")).when(kind == 3, F.col("row_idx") * 2 + F.col("copy"))
    pred = (
        gold.where(~((kind == 2) & (F.col("cells")[1] == "F")) & (kind != 5))
        .withColumn("copy", F.explode(copies))
        .select(
            "pair_id",
            F.lit("pred").alias("side"),
            position.otherwise(F.col("row_idx")).alias("row_idx"),
            F.array(changed, F.col("cells")[1], F.col("cells")[2]).alias("cells"),
        )
    )
    return gold.unionByName(pred)


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pair_id"),
        (F.col("c_custkey") % 12 != 5).alias("pred_ok"),
        F.lit(True).alias("gold_ok"),
        "c_mktsegment",
        "c_nationkey",
    )


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)
