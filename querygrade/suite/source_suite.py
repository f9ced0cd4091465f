"""Registered queries of sources and sinks: tables are written in a form that the library reads, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrade.operators import curate
from querygrade.session import shared_dir
from querygrade.sources import cache_files, questions, sinks
from querygrade.suite.curate_suite import _KEY_SQL, SEED, cache_folder, documents
from querygrade.suite.inputs import table

DATE = "2024-01-02"


def question_files(spark, sf_dir):
    """Documents as question records in JSON lines, CSV and Parquet."""
    docs = documents(spark, sf_dir).select(
        F.col("text").alias("question"), F.col("lang").alias("evidence"), F.col("source").alias("schema"), F.lit("docs").alias("db_id"),
        F.col("doc_id").cast("string").alias("SQL"), (F.col("n_chars") / 8).alias("sql_execution_time"),
    )
    folder = shared_dir(spark, "questions")
    docs.write.json(f"{folder}/q.jsonl")
    docs.drop("question").write.option("header", True).csv(f"{folder}/q.csv")
    docs.write.parquet(f"{folder}/q.parquet")
    columns = ["SQL", "evidence", "schema", "sql_execution_time", F.md5("question").alias("question_md5")]
    read = lambda name, schema: questions.read_questions(spark, f"{folder}/q.{name}", schema).withColumn("file_kind", F.lit(name))
    short = docs.drop("question").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    lines = read("jsonl", questions.QUESTION_SCHEMA).select("file_kind", *columns)
    table_ = read("parquet", None).select("file_kind", *columns)
    return lines.unionByName(table_).unionByName(read("csv", short).select("file_kind", *columns[:-1]), allowMissingColumns=True)


QUESTION_FILES_SQL = """
SELECT file_kind, doc_id::VARCHAR AS SQL, lang AS evidence, source AS schema, n_chars / 8 AS sql_execution_time,
  CASE WHEN file_kind <> 'csv' THEN md5(text) END AS question_md5 FROM documents, (VALUES ('jsonl'), ('csv'), ('parquet')) AS f(file_kind)"""


def named_dataset(spark, sf_dir):
    """One split of a named dataset with a folder for each configuration."""
    folder = shared_dir(spark, "named")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")
    documents(spark, sf_dir).select("doc_id", "lang", split).write.partitionBy("split").parquet(f"{folder}/main")
    return questions.read_split(spark, folder, "main", "test")


def exclusion_file(spark, sf_dir):
    """Documents whose text is not in a file of texts to leave out."""
    folder = shared_dir(spark, "exclusions")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("SQL"))
    docs.join(toxic, "doc_id").select("SQL").write.json(f"{folder}/wrong.jsonl")
    return curate.exclude_listed(docs, questions.read_exclusions(spark, f"{folder}/wrong.jsonl")).select("doc_id")


def mixture_of_files(spark, sf_dir):
    """Two saved datasets, some columns of each, one of them by half, in seeded order and split."""
    folder = shared_dir(spark, "mixture")
    first = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    docs = documents(spark, sf_dir)
    docs.where(first).write.parquet(f"{folder}/one")
    docs.where(~first).write.parquet(f"{folder}/two")
    parts = [curate.MixturePart(f"{folder}/{name}", columns=["doc_id", "lang"], weight=w) for name, w in (("one", 0.5), ("two", 1.0))]
    splits = curate.load_mixture(spark, curate.Mixture(parts, SEED, 0.2), "doc_id")
    return splits["train"].withColumn("split", F.lit("train")).unionByName(splits["test"].withColumn("split", F.lit("test")))


MIXTURE_SQL = f"""
WITH r AS (SELECT doc_id, lang, coalesce(lang IN ('en', 'fr'), FALSE) AS half FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY {_KEY_SQL}) AS place, count(*) OVER (PARTITION BY half) AS n FROM r),
kept AS (SELECT doc_id, lang FROM p WHERE NOT half OR place <= floor(n * 0.5::DOUBLE))
SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY {_KEY_SQL}) <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM kept"""


def report_sink(spark, sf_dir):
    """Two runs of one job and one of another: a run replaces what the same job has saved."""
    folder = shared_dir(spark, "reports")
    report = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("score"))
    for completions, job in ((1, "one"), (1, "one"), (4, "two")):
        sinks.save_report(report, folder, completions, DATE, job)
    saved = spark.read.json(f"{folder}/report")
    return saved.select("o_custkey", "orders", "score", "strategy", F.col("run_date").cast("string").alias("run_date"), "job_id")


REPORT_SINK_SQL = f"""
SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS score, any_value(strategy) AS strategy, '{DATE}' AS run_date, job_id
FROM orders, (VALUES ('greedy', 'one'), ('majority_voting', 'two')) AS j(strategy, job_id) GROUP BY o_custkey, job_id"""


def cache_append(spark, sf_dir):
    """Half of the events, then all, then all again are appended to a cache; each key stays once."""
    events = table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", F.floor("value")).alias("hash_key"), F.col("event_id").alias("row_rank"), "value", "props"
    )
    path = shared_dir(spark, "cache")
    half = events.agg(F.max("row_rank")).first()[0] // 2
    for rows in (events.where(F.col("row_rank") <= half), events, events):
        cache_files.append_to_cache(spark, rows, path)
    return spark.read.parquet(path)


def cache_files_read(spark, sf_dir):
    """What is found in each folder of cache files whose columns differ."""
    rows = cache_files.read_cache_files(spark, cache_folder(spark, sf_dir))
    by_source = rows.groupBy(F.element_at(F.split("source_path", "/"), -2).alias("source"))
    return by_source.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c}") for c in ("value", "props", "ts")])


def unmatched_keys(spark, sf_dir):
    """Customers without an order, and orders of customers that are not in the black."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), "o_orderkey")
    lone = curate.unmatched(customers, orders, ["question_id"]).select("question_id", F.lit(None).cast("long").alias("o_orderkey"))
    return lone.unionByName(curate.unmatched(orders, customers.where("c_acctbal > 0"), ["question_id"]))


QUERIES = {
    "question_files": (question_files, QUESTION_FILES_SQL),
    "named_dataset": (named_dataset, "SELECT doc_id, lang FROM documents WHERE doc_id % 5 = 0"),
    "exclusion_file": (
        exclusion_file,
        "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)",
    ),
    "mixture_of_files": (mixture_of_files, MIXTURE_SQL),
    "report_sink": (report_sink, REPORT_SINK_SQL),
    "cache_append": (
        cache_append,
        "WITH k AS (SELECT user_id || '-' || floor(value)::BIGINT AS hash_key, value, props, row_number() OVER "
        "(PARTITION BY user_id, floor(value) ORDER BY event_id) AS rn FROM events) SELECT hash_key, value, props FROM k WHERE rn = 1",
    ),
    "cache_files_read": (
        cache_files_read,
        "SELECT event_type AS source, count(*) AS rows, count(value) FILTER (event_type <> 'purchase') AS with_value, "
        "count(props) FILTER (event_type <> 'error') AS with_props, count(ts) FILTER (event_type = 'signup') AS with_ts FROM events GROUP BY event_type",
    ),
    "unmatched_keys": (
        unmatched_keys,
        "SELECT c_custkey AS question_id, NULL::BIGINT AS o_orderkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) "
        "UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    ),
}
