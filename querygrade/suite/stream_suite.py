"""Registered queries of the streaming jobs: each table is streamed whole, at once or in steps, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrade.functions import formats, text
from querygrade.operators.length_penalty import penalise_length
from querygrade.session import shared_dir
from querygrade.streaming import groups, jobs
from querygrade.suite import answer_suite, inputs
from querygrade.suite.inputs import ANSWERS_SQL, GENERATIONS, rounded, table


def stream_of(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files; only a pattern may name a single file."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_assemble(spark, sf_dir):
    deltas = stream_of(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request"), F.col("role").alias("choice"), F.col("turn").alias("seq"), F.col("text").alias("delta")
    )
    folder = shared_dir(spark, "assemble")
    jobs.assemble_stream(deltas, ["request", "choice"], folder).awaitTermination()
    return jobs.read_assembled(spark, folder, ["request", "choice"])


def stream_score(spark, sf_dir):
    answers = inputs.answers_of(stream_of(spark, sf_dir, "documents"))
    folder = shared_dir(spark, "score")
    columns = {
        "format_think": formats.format_score(F.col("text"), "think"),
        "tag_count": formats.tag_count_score(F.col("text")),
        "sql_md5": F.md5(text.extract_sql(F.col("text"))),
    }
    jobs.score_stream(answers, lambda batch: batch.select("doc_id", *[c.alias(n) for n, c in columns.items()]), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def in_parts(spark, frame, part, parts, run):
    """Streams a table in ``parts`` steps: adds the rows of one step to a folder and runs the job on what is new."""
    folder = shared_dir(spark, "parts")
    frame = frame.withColumn("part", part)
    schema = frame.drop("part").schema
    query = None
    for number in range(parts):
        frame.where(F.col("part") == number).drop("part").write.parquet(f"{folder}/in/{number}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        query = run(stream, folder)
        query.awaitTermination()
    return query, folder, schema


def stream_length_penalty(spark, sf_dir):
    """The group penalty on a stream of three steps, each with a part of every prompt; one prompt has no id.

    Prompts that never become complete keep their scores.
    """
    answers = inputs.answers_of(table(spark, sf_dir, "documents")).select(
        "doc_id", F.nullif("prompt_id", F.lit(3)).alias("prompt_id"), F.length("text").alias("length"), F.lit(1.0).alias("score")
    )
    score = lambda full: penalise_length(full, "prompt_id", GENERATIONS).select("doc_id", "penalised")
    run = lambda stream, folder: groups.score_groups_stream(stream, "prompt_id", GENERATIONS, score, folder)
    _, folder, schema = in_parts(spark, answers, F.col("doc_id") % 3, 3, run)
    open_groups = groups.read_open(spark, folder, schema).select("doc_id", F.col("score").alias("penalised"))
    scored = spark.read.parquet(f"{folder}/rows").drop("batch").unionByName(open_groups)
    return scored.select("doc_id", rounded("penalised").alias("penalised"))


MEMBERS = 4
_PROMPT = "nullif(concat(lang, '-', CAST(doc_id {div} 12 AS {string})), 'en-3')"


def stream_groups(spark, sf_dir):
    """Groups of four answers or more on a stream of three hours; those without an answer for 90 minutes are closed as they are."""
    answers = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(_PROMPT.format(string="STRING", div="DIV")).alias("prompt"),
        F.timestamp_seconds(1704067200 + F.col("doc_id") % 3 * 3600).alias("arrived"),
    )

    def score(closed):
        sizes = closed.groupBy(F.col("prompt").alias("of")).agg(F.count(F.lit(1)).alias("members"))
        status = F.when(F.col("complete"), "full").otherwise("late").alias("status")
        return closed.join(sizes, F.col("prompt").eqNullSafe(F.col("of"))).select("doc_id", "prompt", status, "members")

    def run(stream, folder):
        timed = stream.withWatermark("arrived", "0 seconds")
        return groups.score_groups_stream(timed, "prompt", MEMBERS, score, folder, patience=5400, arrival="arrived")

    _, folder, schema = in_parts(spark, answers, F.col("doc_id") % 3, 3, run)
    waiting = groups.read_open(spark, folder, schema)
    sizes = waiting.groupBy(F.col("prompt").alias("of")).agg(F.count(F.lit(1)).alias("members"))
    still = waiting.join(sizes, F.col("prompt").eqNullSafe(F.col("of"))).select("doc_id", "prompt", F.lit("open").alias("status"), "members")
    return spark.read.parquet(f"{folder}/rows").drop("batch").unionByName(still)


# How many answers a group holds after each hour, what it does then, and what that makes of each answer.
GROUPS_SQL = f"""
WITH d AS (SELECT doc_id, {_PROMPT.format(string='VARCHAR', div='//')} AS prompt, doc_id % 3 AS part FROM documents),
n AS (SELECT prompt, count(*) FILTER (part = 0) AS c0, count(*) FILTER (part = 1) AS c1, count(*) FILTER (part = 2) AS c2 FROM d GROUP BY prompt),
first AS (SELECT *, CASE WHEN c0 >= {MEMBERS} THEN 0 ELSE c0 END AS k0 FROM n),
second AS (SELECT *, c1 > 0 AND k0 + c1 >= {MEMBERS} AS full1, CASE WHEN c1 > 0 AND k0 + c1 >= {MEMBERS} THEN 0 ELSE k0 + c1 END AS k1 FROM first),
third AS (SELECT *, c2 > 0 AND k1 + c2 >= {MEMBERS} AS full2, c1 = 0 AND c2 = 0 AS silent FROM second)
SELECT doc_id, d.prompt,
  CASE WHEN part = 0 AND c0 >= {MEMBERS} THEN 'full' WHEN part < 2 AND full1 THEN 'full' WHEN full2 THEN 'full' WHEN silent THEN 'late' ELSE 'open' END AS status,
  CASE WHEN part = 0 AND c0 >= {MEMBERS} THEN c0 WHEN part < 2 AND full1 THEN k0 + c1 ELSE k1 + c2 END AS members
FROM d JOIN third ON d.prompt IS NOT DISTINCT FROM third.prompt
"""


def stream_sessions(spark, sf_dir):
    """Turns of conversations that arrive a minute apart; a sign of life a day later closes the last runs."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request"), F.col("role").alias("choice"), F.col("turn").alias("seq"), F.col("text").alias("delta"),
        F.timestamp_seconds(1704067200 + F.col("turn") * 60).alias("arrived"),
    )
    last = turns.agg((F.max("arrived") + F.expr("INTERVAL 1 DAY")).alias("arrived"))
    sign = last.select(*[F.lit(None).cast(t).alias(c) for c, t in turns.dtypes[:-1]], "arrived")
    rows = turns.withColumn("part", F.lit(0)).unionByName(sign.withColumn("part", F.lit(1)))
    keys = ["request", "choice"]
    run = lambda stream, folder: jobs.assemble_stream_until(stream, keys, "arrived", "5 minutes", "10 minutes", folder)
    query, folder, _ = in_parts(spark, rows, F.col("part"), 2, run)
    return jobs.read_assembled(spark, folder, keys).withColumn("open_runs", F.lit(jobs.open_runs(query)))


def stream_cache(spark, sf_dir):
    """Events arrive in two steps; the second reads the ranges of the cache that its keys lie in."""
    events = table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", F.floor("value")).alias("hash_key"), F.col("event_id").alias("row_rank"), "value", "props"
    )
    half = events.agg(F.max("row_rank")).first()[0] // 2
    _, folder, _ = in_parts(spark, events, (F.col("row_rank") > half).cast("int"), 2, jobs.append_to_cache_stream)
    return jobs.read_cache(spark, folder)


QUERIES = {
    "stream_assemble": (stream_assemble, answer_suite.DELTA_SQL),
    "stream_score": (
        stream_score,
        f"WITH {ANSWERS_SQL} SELECT doc_id, {answer_suite._form_sql('think', 'answer')} AS format_think, "
        f"CAST({answer_suite._REWARD_SQL['tag_count']} AS DOUBLE) AS tag_count, md5({answer_suite._EXTRACT_SQL}) AS sql_md5 FROM answers",
    ),
    "stream_length_penalty": (
        stream_length_penalty,
        f"WITH {ANSWERS_SQL}, {answer_suite._length_sql('1.0::DOUBLE')} SELECT doc_id, round(lowered, 6) AS penalised FROM penalised",
    ),
    "stream_groups": (stream_groups, GROUPS_SQL),
    "stream_sessions": (stream_sessions, answer_suite.DELTA_SQL.replace("SELECT", "SELECT 0 AS open_runs,", 1)),
    "stream_cache": (
        stream_cache,
        "WITH k AS (SELECT user_id || '-' || floor(value)::BIGINT AS hash_key, value, props, row_number() OVER "
        "(PARTITION BY user_id, floor(value) ORDER BY event_id) AS rn FROM events) SELECT hash_key, value, props FROM k WHERE rn = 1",
    ),
}
