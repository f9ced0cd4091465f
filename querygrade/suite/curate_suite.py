"""Registered queries of curation, prompts, caches, catalog and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrade.functions.cells import query_key
from querygrade.operators import cache, curate, prompts, report, sampling
from querygrade.operators.compare import METRICS, metrics_long
from querygrade.session import shared_dir
from querygrade.sources import cache_files, databases
from querygrade.suite import compare_suite
from querygrade.suite.inputs import rounded, table

SEED = 2025
_KEY_SQL = f"md5('{SEED}-' || doc_id)"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- mixing, sampling, splitting -------------------------------------------------------------

WEIGHTS = {"de": 0.5, "en": 0.25, "es": 1.0, "fr": 0.125}


def mix_weighted(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    parts = [(docs.where(F.col("lang") == lang), weight) for lang, weight in WEIGHTS.items()]
    return curate.mix(parts, "doc_id", SEED).select("doc_id", "lang", F.md5("text").alias("text_md5"))


MIX_SQL = f"""
WITH w(lang, weight) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())}),
r AS (SELECT doc_id, lang, text, weight, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY {_KEY_SQL}) AS place FROM documents JOIN w USING (lang))
SELECT doc_id, lang, md5(text) AS text_md5 FROM r WHERE place <= floor(n * weight::DOUBLE)
"""


def mix_union(spark, sf_dir):
    part = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.md5("text").alias("text_md5"), F.lit(name).alias("part"))
    return curate.union_all([part("documents", "doc_id"), part("benchmark", "item_id"), part("conversations", "conv_id")])


def shuffle_seeded(spark, sf_dir):
    ordered = sampling.shuffled(documents(spark, sf_dir), "doc_id", SEED)
    return ordered.select("doc_id", sampling.shuffle_key("doc_id", SEED).alias("shuffle_key"))


def split_train_test(spark, sf_dir):
    return sampling.with_split(documents(spark, sf_dir), "doc_id", SEED, 0.2).select("doc_id", "split")


SPLIT_SQL = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_KEY_SQL}) <= ceil(count(*) OVER () * 0.2::DOUBLE)
THEN 'test' ELSE 'train' END AS split FROM documents"""


def subset_ratio(spark, sf_dir):
    return sampling.with_smallest_subset(documents(spark, sf_dir), "doc_id", SEED).select("doc_id", "subset")


SUBSET_SQL = f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY_SQL}) AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, {" + ".join(f"(place <= n // {2 ** i})::INT" for i in range(1, 6))} AS subset FROM r"""


def exclude_wrong(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    wrong = documents(spark, sf_dir).join(toxic, "doc_id", "left_semi").select("text")
    return curate.exclude_listed(documents(spark, sf_dir), wrong, "text").select("doc_id")


def timed_questions(spark, sf_dir):
    """Orders as questions: time -1 for one status, null for another."""
    status = F.col("o_orderstatus")
    time = F.when(status == "P", -1.0).when(status == "O", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("SQL"), F.lit("m").alias("messages"), time.alias("sql_execution_time")
    )


def filter_bad_gold(spark, sf_dir):
    return curate.drop_bad_gold(timed_questions(spark, sf_dir)).select("o_orderkey", "sql_execution_time")


def filter_counted(spark, sf_dir):
    """The rows that are kept, and how many there were before and after."""
    kept, counts = curate.save_filtered(timed_questions(spark, sf_dir), F.col("sql_execution_time") > 100000, shared_dir(spark, "filtered"))
    rows = kept.select(F.lit("row").alias("step"), F.lit(None).cast("long").alias("rows"), "o_orderkey", "sql_execution_time")
    return rows.unionByName(counts, allowMissingColumns=True)


def training_columns(spark, sf_dir):
    return curate.training_columns(timed_questions(spark, sf_dir)).drop("sql_execution_time")


def replicate(spark, sf_dir):
    return curate.replicate(table(spark, sf_dir, "orders").select("o_orderkey"), 3)


# --- prompts ---------------------------------------------------------------------------------

USER_TEMPLATE = "Write one query.\nQuestion: {{ question }}\nHints: {{evidence}}\nTables:\n{{ schema }} \n\n"
SYSTEM_TEMPLATE = "Answer with SQL only.\n"
_USER_SQL = "'Write one query.' || chr(10) || 'Question: ' || text || chr(10) || 'Hints: ' || lang || chr(10) || 'Tables:' || chr(10) || source || chr(10)"


def questions(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("question"), F.col("lang").alias("evidence"), F.col("source").alias("schema"), F.col("source").alias("SQL")
    )


def render_prompt(spark, sf_dir):
    prompt = prompts.render(USER_TEMPLATE)
    return questions(spark, sf_dir).select("doc_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("prompt_length"))


def build_messages(spark, sf_dir):
    built = prompts.build_messages(questions(spark, sf_dir), USER_TEMPLATE, SYSTEM_TEMPLATE, "SQL")
    messages = built.select("doc_id", F.posexplode(F.concat("prompt", "completion")).alias("place", "message"))
    return messages.select("doc_id", "place", F.col("message.role").alias("role"), F.md5("message.content").alias("content_md5"))


MESSAGES_SQL = f"""
SELECT doc_id, 0 AS place, 'system' AS role, md5('Answer with SQL only.' || chr(10)) AS content_md5 FROM documents
UNION ALL SELECT doc_id, 1, 'user', md5({_USER_SQL}) FROM documents
UNION ALL SELECT doc_id, 2, 'assistant', md5(source) FROM documents
"""

# --- caches: events as cache rows, one source per event type, columns differ ------------------

CACHE_COLUMNS = {
    "click": ["value", "props"],
    "error": ["value"],
    "purchase": ["props"],
    "signup": ["value", "props", "ts"],
    "view": ["props", "value"],
}


def cache_folder(spark, sf_dir):
    """Events as cache files, one folder per type with columns of its own, rows in order of their ids."""
    events = table(spark, sf_dir, "events").withColumn("hash_key", F.concat_ws("-", "user_id", F.floor("value")))
    folder = shared_dir(spark, "caches")
    for name, columns in CACHE_COLUMNS.items():
        own = events.where(F.col("event_type") == name).orderBy("event_id")
        own.select("hash_key", *columns).write.parquet(f"{folder}/{name}")
    return folder


def merged_cache(spark, sf_dir):
    rows = cache_files.read_cache_files(spark, cache_folder(spark, sf_dir))
    return cache.merge_cache_rows(rows).withColumn("source", F.element_at(F.split("source_path", "/"), -2))


def cache_merge(spark, sf_dir):
    return merged_cache(spark, sf_dir).select("hash_key", "source", "value", "props", "ts")


CACHE_SQL = """
WITH s AS (SELECT user_id || '-' || floor(value)::BIGINT AS hash_key, event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS source_rank,
  event_type AS source, CASE WHEN event_type <> 'purchase' THEN value END AS value, CASE WHEN event_type <> 'error' THEN props END AS props,
  CASE WHEN event_type = 'signup' THEN ts END AS ts FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY hash_key ORDER BY source_rank, event_id) AS rn FROM s)
"""


def cache_inserted(spark, sf_dir):
    return merged_cache(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("inserted"))


def workload(spark, sf_dir):
    sql = F.concat(F.lit("SELECT * FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lit("sales").alias("db_id"), sql.alias("sql"))


def stored(spark, sf_dir):
    sql = F.concat(F.lit("SELECT * FROM orders WHERE o_custkey = "), F.col("c_custkey").cast("string"))
    few = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return few.select(query_key(F.lit("sales"), sql).alias("hash_key"))


def _lookup(step):
    return lambda spark, sf_dir: step(cache.with_key(workload(spark, sf_dir)), stored(spark, sf_dir)).select("o_orderkey", "hash_key")


def _lookup_sql(negate):
    return f"""
WITH w AS (SELECT o_orderkey, sha256('sales' || chr(1) || 'SELECT * FROM orders WHERE o_custkey = ' || o_custkey) AS hash_key FROM orders),
c AS (SELECT sha256('sales' || chr(1) || 'SELECT * FROM orders WHERE o_custkey = ' || c_custkey) AS hash_key FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, hash_key FROM w WHERE hash_key {negate} IN (SELECT hash_key FROM c)"""


# --- catalog ---------------------------------------------------------------------------------

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


def catalog_scan(spark, sf_dir):
    """Columns of every table in order, beside the number of rows they describe."""
    catalog = databases.catalog_tables(databases.catalog_rows(spark, {"sales": sf_dir}))
    counts = [table(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name in TABLES]
    return catalog.join(curate.union_all(counts), "table_name").select("table_name", F.array_join("columns", ",").alias("columns"), "n_rows")


CATALOG_SQL = (
    "WITH n AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
    + ") SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns, any_value(n_rows) AS n_rows "
    "FROM information_schema.columns JOIN n USING (table_name) GROUP BY table_name"
)

# --- reports on the result metrics -----------------------------------------------------------


def scores(spark, sf_dir):
    keys = ["pair_id", "experiment", "dataset_name", "model_name"]
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pair_id"),
        (F.col("c_nationkey") % 3).alias("experiment"),
        F.col("c_mktsegment").alias("dataset_name"),
        F.concat(F.lit("model_"), (F.col("c_custkey") % 2).cast("string")).alias("model_name"),
    )
    metrics = compare_suite.all_metrics(spark, sf_dir).join(customers, "pair_id")
    return metrics_long(metrics, keys, METRICS).withColumn("number_of_completions", F.lit(1))


SCORES_SQL = (
    compare_suite.METRIC_SQL
    + """, scores AS (
  UNPIVOT (SELECT pair_id, c_nationkey % 3 AS experiment, c_mktsegment AS dataset_name, 'model_' || (pair_id % 2) AS model_name, """
    + ", ".join(METRICS)
    + " FROM metrics) ON "
    + ", ".join(METRICS)
    + """ INTO NAME score_name VALUE score),
means AS (SELECT dataset_name, model_name, score_name, experiment, avg(score) AS mean_score FROM scores GROUP BY ALL),
summary AS (SELECT 1 AS number_of_completions, dataset_name, model_name, score_name, round(avg(mean_score) * 100, 3) AS score,
            round(coalesce(stddev_samp(mean_score), 0) * 100, 3) AS std FROM means GROUP BY ALL)
"""
)


def report_experiment(spark, sf_dir):
    means = report.experiment_means(scores(spark, sf_dir))
    return means.withColumn("mean_score", rounded("mean_score"))


def report_summary(spark, sf_dir):
    return report.summarise(scores(spark, sf_dir))


def report_suite(spark, sf_dir):
    return report.leaderboard(report.summarise(scores(spark, sf_dir)))


def report_wide(spark, sf_dir):
    """Orders of a customer as experiments: their priority as text, their price as metric."""
    frame = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 3).alias("experiment")).agg(
        F.max("o_orderpriority").alias("priority"), F.max("o_totalprice").alias("price")
    )
    return report.wide_report(frame, "o_custkey", "m", 3, {"Pred": "priority", "bird_ex": "price"})


WIDE_SQL = (
    "SELECT o_custkey, "
    + ", ".join(
        f'max({column}) FILTER (o_orderkey % 3 = {i}) AS "{prefix}_m_{i}"'
        for prefix, column in (("Pred", "o_orderpriority"), ("bird_ex", "o_totalprice"))
        for i in range(3)
    )
    + " FROM orders GROUP BY o_custkey"
)

QUERIES = {
    "mix_weighted": (mix_weighted, MIX_SQL),
    "mix_union": (
        mix_union,
        "SELECT doc_id AS id, md5(text) AS text_md5, 'documents' AS part FROM documents UNION ALL SELECT item_id, md5(text), 'benchmark' FROM benchmark "
        "UNION ALL SELECT conv_id, md5(text), 'conversations' FROM conversations",
    ),
    "shuffle_seeded": (shuffle_seeded, f"SELECT doc_id, {_KEY_SQL} AS shuffle_key FROM documents"),
    "split_train_test": (split_train_test, SPLIT_SQL),
    "subset_ratio": (subset_ratio, SUBSET_SQL),
    "exclude_wrong": (
        exclude_wrong,
        "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)",
    ),
    "filter_bad_gold": (
        filter_bad_gold,
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS sql_execution_time FROM orders WHERE o_orderstatus <> 'P'",
    ),
    "filter_counted": (
        filter_counted,
        "WITH kept AS (SELECT o_orderkey, o_totalprice AS sql_execution_time FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000) "
        "SELECT 'row' AS step, NULL::BIGINT AS rows, o_orderkey, sql_execution_time FROM kept "
        "UNION ALL SELECT 'before', count(*), NULL, NULL FROM orders UNION ALL SELECT 'after', count(*), NULL, NULL FROM kept",
    ),
    "training_columns": (training_columns, "SELECT o_orderkey, o_orderpriority AS target_sql FROM orders"),
    "replicate_experiments": (replicate, "SELECT o_orderkey, unnest([0, 1, 2]) AS experiment FROM orders"),
    "render_prompt": (render_prompt, f"SELECT doc_id, md5({_USER_SQL}) AS prompt_md5, length({_USER_SQL}) AS prompt_length FROM documents"),
    "build_messages": (build_messages, MESSAGES_SQL),
    "cache_merge": (cache_merge, CACHE_SQL + "SELECT hash_key, source, value, props, ts FROM m WHERE rn = 1"),
    "cache_inserted": (cache_inserted, CACHE_SQL + "SELECT source, count(*) AS inserted FROM m WHERE rn = 1 GROUP BY source"),
    "cache_hits": (_lookup(cache.cache_hits), _lookup_sql("")),
    "cache_misses": (_lookup(cache.cache_misses), _lookup_sql("NOT")),
    "catalog_scan": (catalog_scan, CATALOG_SQL),
    "report_experiment": (
        report_experiment,
        SCORES_SQL + "SELECT 1 AS number_of_completions, dataset_name, model_name, score_name, experiment, round(mean_score, 6) AS mean_score FROM means",
    ),
    "report_summary": (report_summary, SCORES_SQL + "SELECT * FROM summary"),
    "report_suite": (
        report_suite,
        SCORES_SQL + "SELECT *, rank() OVER (PARTITION BY dataset_name, score_name ORDER BY score DESC) AS place FROM summary",
    ),
    "report_wide": (report_wide, WIDE_SQL),
}
