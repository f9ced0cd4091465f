"""Registered queries of answer parsing, format scores, recall, penalties and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrade.functions import formats, scores, text
from querygrade.operators import completions, language, report, rewards
from querygrade.operators.length_penalty import penalise_length, penalty_statistics
from querygrade.session import shared_dir
from querygrade.suite import inputs
from querygrade.suite.inputs import ANSWERS_SQL, GENERATIONS, answers, documents, graded_answers, rounded, table

_WS = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def _strip_sql(value: str) -> str:
    return f"trim({value}, {_WS})"


def _body_sql(tag: str, value: str = "text") -> str:
    pattern = f"(?s)<{tag}>\\n(.*?)\\n</{tag}>"
    body = _strip_sql(f"regexp_extract({value}, '{pattern}', 1)")
    return f"(CASE WHEN regexp_matches({value}, '{pattern}') THEN {body} END)"


_FENCE = "(?s)```sql(.*?)```"
_FENCE_SQL = (
    f"CASE WHEN regexp_matches(text, '{_FENCE}') THEN "
    + _strip_sql(f"regexp_extract_all(text, '{_FENCE}', 1)[-1]")
    + " END"
)
_EXTRACT_SQL = (
    f"coalesce({_FENCE_SQL}, CASE WHEN json_valid({_body_sql('answer')}) THEN json_extract_string({_body_sql('answer')}, '$.sql') END, "
    f"{_body_sql('answer')}, text)"
)


def _form_sql(*tags: str) -> str:
    seams = "".join(f".*?</{a}>\\s*<{b}>" for a, b in zip(tags, tags[1:]))
    return f"regexp_matches({_strip_sql('text')}, '(?is)\\A<{tags[0]}>{seams}.*</{tags[-1]}>\\z')::INT::DOUBLE"


def _count_sql(literal: str) -> str:
    return f"((length(text) - length(replace(text, '{literal}', ''))) / length('{literal}'))"


def _structure_sql(think: str = "reasoning", answer: str = "answer") -> str:
    tags = [f"<{think}>", f"</{think}>", f"<{answer}>", f"</{answer}>"]
    once = " AND ".join(f"{_count_sql(t)} = 1" for t in tags)
    order = " AND ".join(f"instr(text, '{a}') <= instr(text, '{b}')" for a, b in zip(tags, tags[1:]))
    return f"({once} AND {order})"


def _column_query(name, column):
    """A query that shows one stateless column for every answer."""
    return lambda spark, sf_dir: answers(spark, sf_dir).select("doc_id", column(F.col("text")).alias(name))


def _column_sql(name, expression):
    return f"WITH {ANSWERS_SQL} SELECT doc_id, {expression} AS {name} FROM answers"


def _both(name, column, expression):
    return {name: (_column_query(name, column), _column_sql(name, expression))}


# --- recall: a list of names behind the whole text of each document --------------------------

RECALL_SQL = """
WITH listed AS (
  SELECT doc_id, text || chr(10) || '<TAG>' || chr(10) || upper(lang) || ', `' || source || '`, "src' || (doc_id % 3) || '"' ||
         chr(10) || '</TAG>' AS text,
         [lang, source, 'src' || (doc_id % 2)] AS truth FROM documents),
said AS (SELECT doc_id, truth, list_transform(string_split(regexp_extract(text, '(?s)<TAG>\\n(.*?)\\n</TAG>', 1), ','),
                lambda x: translate(lower(trim(x)), 'QUOTES', '')) AS names FROM listed)
SELECT doc_id, len(list_intersect(list_distinct(names), list_distinct(truth)))::DOUBLE / len(list_distinct(truth)) AS NAME FROM said
"""


def _listed(spark, sf_dir, tag):
    listing = F.concat(
        F.col("text"), F.lit(f"\n<{tag}>\n"), F.upper("lang"), F.lit(", `"), F.col("source"), F.lit('`, "src'),
        (F.col("doc_id") % 3).cast("string"), F.lit(f'"\n</{tag}>'),
    )
    truth = F.array("lang", "source", F.concat(F.lit("src"), (F.col("doc_id") % 2).cast("string")))
    return documents(spark, sf_dir).select("doc_id", listing.alias("text"), truth.alias("truth"))


def _recall_sql(tag, quotes, name):
    return RECALL_SQL.replace("TAG", tag).replace("QUOTES", quotes).replace("NAME", name)


def _recall(tag, score, name):
    return lambda spark, sf_dir: _listed(spark, sf_dir, tag).select(
        "doc_id", score(F.col("text"), F.col("truth")).alias(name)
    )


# --- whole texts as they are -----------------------------------------------------------------

_KEYWORDS = "|".join(text.WRITE_KEYWORDS)


def guard(spark, sf_dir):
    checked = documents(spark, sf_dir).select("doc_id", text.read_only_or_marker(F.col("text")).alias("checked"))
    return checked.select("doc_id", F.md5("checked").alias("checked_md5"), F.length("checked").alias("checked_length"))


def quotes(spark, sf_dir):
    sql = F.concat(F.lit("SELECT `"), F.col("source"), F.lit("` FROM `"), F.col("lang"), F.lit("` WHERE note = '"), F.col("text"), F.lit("'"))
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(text.double_quote_identifiers(sql)).alias("rewritten_md5")
    )


def identifiers(spark, sf_dir):
    names = text.identifier_set(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(names).alias("n_names"), F.md5(F.array_join(names, "|")).alias("names_md5")
    )


IDENTIFIERS_SQL = f"""
WITH n AS (SELECT doc_id, list_transform(string_split(text, ','), lambda x: translate(lower({_strip_sql('x')}), '`"''', '')) AS all_names FROM documents),
u AS (SELECT doc_id, list_filter(all_names, lambda x, i: list_position(all_names, x) = i) AS names FROM n)
SELECT doc_id, len(names) AS n_names, md5(array_to_string(names, '|')) AS names_md5 FROM u
"""


def blocks_removed(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", F.md5(text.remove_sql_blocks(F.col("text"))).alias("prose_md5"))


def json_choices(spark, sf_dir):
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))
    choice = lambda i, content: F.struct(F.lit(i).alias("index"), message("assistant", content).alias("message"))
    response = F.to_json(F.struct(F.array(choice(0, "text"), choice(1, "source"), choice(2, "lang")).alias("choices")))
    saved = documents(spark, sf_dir).select("doc_id", response.alias("response"))
    return completions.choices_of_responses(saved).select("doc_id", "sample_idx", F.md5("text").alias("text_md5"))


def unwrapped(spark, sf_dir):
    content = lambda name: F.struct(F.col(name).alias("content"))
    wrapped = documents(spark, sf_dir).select("doc_id", F.array(content("text"), content("source")).alias("completion"))
    return completions.unwrap_completions(wrapped).select("doc_id", "sample_idx", F.md5("text").alias("text_md5"))


def deltas(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request"), F.col("role").alias("choice"), F.col("turn").alias("seq"), F.col("text").alias("delta")
    )


def delta_assemble(spark, sf_dir):
    return completions.assemble_deltas(deltas(spark, sf_dir), ["request", "choice"])


DELTA_SQL = (
    "SELECT conv_id AS request, role AS choice, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text "
    "FROM conversations GROUP BY ALL"
)


def limits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rounded(text.time_limit(F.col("o_totalprice") / 1000)).alias("timeout_s")
    )


def short_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.short_model_name(F.concat("url", F.lit(".json"))).alias("model_name"),
        text.short_dataset_name(F.concat("url", F.lit(".json"))).alias("dataset_name"),
    )


# --- penalties -------------------------------------------------------------------------------

LANGUAGES = ["de", "en", "es", "fr"]


def repetition(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", scores.repetition_penalty(F.split("text", " ")).alias("penalty")
    )


REPETITION_SQL = """
WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
g AS (SELECT doc_id, len(w) - 4 AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1))) AS grams FROM t)
SELECT doc_id, CASE WHEN n < 1 THEN 0.0::DOUBLE WHEN len(list_distinct(grams))::DOUBLE / n < 0.5 THEN -1.0 ELSE 0.0 END AS penalty FROM g
"""


def language_words(spark, sf_dir):
    """The language profile of all documents, stored as a table."""
    path = shared_dir(spark, "profile")
    language.language_profile(documents(spark, sf_dir), "text", "lang", LANGUAGES).write.parquet(path)
    return spark.read.parquet(path)


def not_english(spark, sf_dir):
    return language.foreign_language_penalty(answers(spark, sf_dir), "doc_id", "text", language_words(spark, sf_dir), LANGUAGES)


NOT_ENGLISH_SQL = f"""
WITH {ANSWERS_SQL},
labelled AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents),
profile AS (SELECT word, {", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGUAGES)} FROM labelled GROUP BY word),
mass AS (SELECT {", ".join(f"ln(sum({x}) + count(*)) AS {x}" for x in LANGUAGES)} FROM profile),
prose AS (SELECT doc_id, length({_strip_sql('text')}) < 5 AS short, regexp_replace(text, '(?s)```sql.*?```', '', 'g') AS t FROM answers),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS word FROM prose WHERE NOT short),
sums AS (SELECT w.doc_id, {", ".join(f"sum(coalesce(ln(p.{x} + 1.0), 0)) - count(*) * any_value(m.{x}) AS {x}" for x in LANGUAGES)}
         FROM words w LEFT JOIN profile p USING (word) CROSS JOIN mass m GROUP BY w.doc_id)
SELECT p.doc_id, CASE WHEN s.en IS NOT NULL AND 1.0 / ({" + ".join(f"exp(least(s.{x} - s.en, 700))" for x in LANGUAGES)}) < 0.9
       THEN -1.0 ELSE 0.0 END::DOUBLE AS penalty
FROM prose p LEFT JOIN sums s USING (doc_id)
"""


def _lengths(spark, sf_dir):
    return graded_answers(spark, sf_dir).withColumn("length", F.length("text"))


def length_penalty(spark, sf_dir):
    return penalise_length(_lengths(spark, sf_dir), "prompt_id", GENERATIONS).select(
        "doc_id", rounded("penalty").alias("penalty"), rounded("penalised").alias("penalised")
    )


def _length_sql(score: str) -> str:
    return f"""
scored AS (SELECT *, {score} AS s, length(text) AS len FROM answers),
stats AS (SELECT prompt_id, avg(len) FILTER (s > 0.5) AS a, stddev_samp(len) FILTER (s > 0.5) AS sd FROM scored GROUP BY prompt_id
          HAVING count(*) >= 8 AND count(*) FILTER (s > 0.5) >= 2),
z AS (SELECT scored.*, a, greatest(sd, 0.2 * a) AS spread, (len - a) / greatest(sd, 0.2 * a) AS z FROM scored LEFT JOIN stats USING (prompt_id)),
pen AS (SELECT *, CASE WHEN s > 0 AND z > 0 THEN least(0.9, 0.1 * z) ELSE 0.0 END AS penalty FROM z),
penalised AS (SELECT *, CASE WHEN penalty > 0 THEN greatest(0.0, s - penalty) ELSE s END AS lowered FROM pen)
"""


LENGTH_SQL = f"WITH {ANSWERS_SQL}, {_length_sql('score')} SELECT doc_id, round(penalty, 6) AS penalty, round(lowered, 6) AS penalised FROM penalised"


def length_stats(spark, sf_dir):
    return penalty_statistics(_lengths(spark, sf_dir), "prompt_id", GENERATIONS).select(
        "prompt_id", *[rounded(c, 4).alias(c) for c in ("avg_length", "spread", "mean_penalty")]
    )


LENGTH_STATS_SQL = f"""WITH {ANSWERS_SQL}, {_length_sql('score')}
SELECT prompt_id, round(any_value(a), 4) AS avg_length, round(any_value(spread), 4) AS spread,
       round(coalesce(avg(penalty) FILTER (penalty > 0), 0), 4) AS mean_penalty
FROM penalised WHERE a IS NOT NULL GROUP BY prompt_id"""


def format_failures(spark, sf_dir):
    return report.format_failures(answers(spark, sf_dir), "lang")


FORMAT_FAILURES_SQL = f"""WITH {ANSWERS_SQL}, f AS (SELECT lang, {_form_sql('think', 'answer')} = 0 AS failed FROM answers)
SELECT lang, count(*) FILTER (failed) AS failed, count(*) AS answers, count(*) FILTER (failed) / count(*) AS failed_share FROM f GROUP BY lang"""


# --- rewards: the metrics of a graded answer come from its label and its length --------------


def rewarded(spark, sf_dir):
    """Graded answers with metric columns: the label as match, a graded value as combined metric."""
    graded = graded_answers(spark, sf_dir)
    names = F.array("lang", "source")
    return graded.select(
        "*",
        F.col("score").alias("bird_ex"),
        F.when(F.col("doc_id") % 2 == 0, F.col("score")).otherwise(0.0).alias("ex"),
        F.when(F.col("score") == 1, 1.0).otherwise((F.length("body") % 10) / 10.0).alias("cp_cr_tc"),
        names.alias("tbls_in_query"),
        names.alias("cols_in_query"),
        F.split("body", " ").alias("token_ids"),
    )


_METRICS_SQL = {
    "bird_ex": "score",
    "ex": "CASE WHEN doc_id % 2 = 0 THEN score ELSE 0.0 END",
    "cp_cr_tc": "CASE WHEN score = 1 THEN 1.0::DOUBLE ELSE (length(body) % 10)::DOUBLE / 10.0 END",
}


def _metric_sql(metric):
    return f"(CASE WHEN both_ran THEN {_METRICS_SQL[metric]} ELSE 0.0 END)"


def _stepwise_sql(metric):
    think = f"coalesce(nullif({_body_sql('reasoning')}, ''), text)"
    answer = f"coalesce(nullif({_body_sql('answer')}, ''), text)"
    return (
        f"CASE WHEN NOT {_structure_sql()} OR NOT both_ran THEN -1.0::DOUBLE WHEN {_METRICS_SQL[metric]} <= 0 THEN 0.0 "
        f"ELSE 6 + least(length({think}) + length({answer}), 2048)::DOUBLE / 2048 * 0.5 + length({_EXTRACT_SQL})::DOUBLE / length({answer}) END"
    )


def _run_or_match_sql(metric):
    return (
        f"CASE WHEN NOT both_ran THEN 0.0::DOUBLE WHEN {_METRICS_SQL[metric]} > 0 THEN 1.0 "
        f"WHEN {_body_sql('reasoning')} IS NOT NULL AND {_body_sql('answer')} IS NOT NULL THEN 0.1 ELSE 0.0 END"
    )


def _small_sql(metric, gated=False, steps=False):
    m = _METRICS_SQL[metric]
    gate = f"WHEN {_form_sql('think', 'answer')} = 0 THEN 0.0" if gated else ""
    graded = (
        f"CASE WHEN {m} < 0.1 THEN 0.1 WHEN {m} < 0.5 THEN 0.5 WHEN {m} < 0.8 THEN 0.8 ELSE 0.9 END"
        if steps
        else f"greatest({m}, 0.1)"
    )
    return f"CASE WHEN NOT both_ran THEN 0.0::DOUBLE WHEN {m} = 1 THEN 1.0 {gate} ELSE {graded} END"


def _reward(name, alias="reward"):
    return lambda spark, sf_dir: rewards.named_rewards(rewarded(spark, sf_dir), [name], "prompt_id", GENERATIONS).select(
        "doc_id", rounded(name).alias(alias)
    )


def _reward_sql(expression, alias="reward"):
    return f"WITH {ANSWERS_SQL} SELECT doc_id, round({expression}, 6) AS {alias} FROM answers"


WEIGHTS = {"EX": 0.85, "format": 0.15}


def weighted(spark, sf_dir):
    named = rewards.named_rewards(rewarded(spark, sf_dir), list(WEIGHTS))
    total = rewards.weighted_sum({name: F.col(name) for name in WEIGHTS}, WEIGHTS)
    return named.select("doc_id", rounded(total).alias("reward"))


def scaled(spark, sf_dir):
    named = rewards.named_rewards(rewarded(spark, sf_dir), ["QATCH"]).select("doc_id", "prompt_id", "QATCH")
    frames = [rewards.scale_rewards(named, "QATCH", "prompt_id", by).withColumn("scaled_by", F.lit(by)) for by in ("group", "batch", "none")]
    union = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return union.select("doc_id", "scaled_by", rounded("scaled").alias("scaled"))


SCALED_SQL = f"""WITH {ANSWERS_SQL}, r AS (SELECT doc_id, prompt_id, {_metric_sql('cp_cr_tc')} AS r FROM answers),
w AS (SELECT doc_id, r - avg(r) OVER p AS c, coalesce(stddev_samp(r) OVER p, 0) AS gs, stddev_samp(r) OVER () AS bs FROM r WINDOW p AS (PARTITION BY prompt_id))
SELECT doc_id, 'group' AS scaled_by, round(c / (gs + 1e-4), 6) AS scaled FROM w
UNION ALL SELECT doc_id, 'batch', round(c / (bs + 1e-4), 6) FROM w
UNION ALL SELECT doc_id, 'none', round(c, 6) FROM w"""

ALL_REWARDS = list(rewards.REWARD_NAMES)


def all_rewards(spark, sf_dir):
    """All names of the registry from raw answers, as mean per language."""
    profile = rewards.LanguageProfile(language_words(spark, sf_dir), LANGUAGES)
    named = rewards.named_rewards(rewarded(spark, sf_dir), ALL_REWARDS, "prompt_id", GENERATIONS, "doc_id", profile)
    return named.groupBy("lang").agg(*[rounded(F.avg(n), 6).alias(n.replace("-", "_").lower()) for n in ALL_REWARDS])


_REWARD_SQL = {
    "EX": _metric_sql("bird_ex"),
    "EX_EX": _metric_sql("ex"),
    "QATCH": _metric_sql("cp_cr_tc"),
    "format": _form_sql("reasoning", "answer"),
    "format_think": _form_sql("think", "answer"),
    "tag_count": "0.25 * ("
    + " + ".join(f"({_count_sql(m)} = 1)::INT" for m in formats.QUARTER_MARKS)
    + ")",
    "multi_tag_format": _form_sql(*formats.FULL_FORM),
    "table_recall": f"CASE WHEN {_body_sql('tables')} IS NULL THEN 0.0 ELSE (list_contains(list_transform(string_split({_body_sql('tables')}, ','), lambda x: translate(lower(trim(x)), '`\"''', '')), lang)::INT + list_contains(list_transform(string_split({_body_sql('tables')}, ','), lambda x: translate(lower(trim(x)), '`\"''', '')), source)::INT) / 2.0 END",
    "column_recall": f"CASE WHEN {_body_sql('columns')} IS NULL THEN 0.0 ELSE (list_contains(list_transform(string_split({_body_sql('columns')}, ','), lambda x: translate(lower(trim(x)), '`', '')), lang)::INT + list_contains(list_transform(string_split({_body_sql('columns')}, ','), lambda x: translate(lower(trim(x)), '`', '')), source)::INT) / 2.0 END",
    "SQL-R1": _stepwise_sql("bird_ex"),
    "arctic_sql": _run_or_match_sql("bird_ex"),
    "SQL-R1-EX": _stepwise_sql("ex"),
    "arctic_sql_EX": _run_or_match_sql("ex"),
    "qatch_small_update": _small_sql("cp_cr_tc"),
    "ex_small_update": _small_sql("bird_ex"),
    "qatch_small_update_with_fm": _small_sql("cp_cr_tc", gated=True),
    "qatch_small_update_fm_with_buckets": _small_sql("cp_cr_tc", gated=True, steps=True),
    "ex_small_update_with_fm": _small_sql("bird_ex", gated=True),
    "penalty_repetitions": "(SELECT CASE WHEN len(w) < 5 THEN 0.0::DOUBLE WHEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1)))))::DOUBLE / (len(w) - 4) < 0.5 THEN -1.0 ELSE 0.0 END FROM (SELECT string_split(body, ' ') AS w))",
    "penalty_no_format": _form_sql("reasoning", "answer") + " - 1",
}
_TABLE_SQL = {"penalty_not_english": NOT_ENGLISH_SQL, "qatch_complex": "cp_cr_tc", "ex_complex": "bird_ex"}


def _own_sql(name):
    """Rewards that are no expression over one answer, each as a query of its own."""
    if name == "penalty_not_english":
        return f"SELECT doc_id, penalty AS {name} FROM ({NOT_ENGLISH_SQL})"
    return f"SELECT doc_id, lowered AS {name} FROM (WITH {ANSWERS_SQL}, {_length_sql(_metric_sql(_TABLE_SQL[name]))} SELECT * FROM penalised)"


ALL_REWARDS_SQL = (
    f"WITH {ANSWERS_SQL}, "
    + ", ".join(f"of_{n} AS ({_own_sql(n)})" for n in _TABLE_SQL)
    + " SELECT lang, "
    + ", ".join(f"round(avg({_REWARD_SQL.get(n, n)}), 6) AS {n.replace('-', '_').lower()}" for n in ALL_REWARDS)
    + " FROM answers "
    + " ".join(f"JOIN of_{n} USING (doc_id)" for n in _TABLE_SQL)
    + " GROUP BY lang"
)

QUERIES = {
    **_both("reasoning_body", lambda t: text.tag_body(t, "reasoning"), _body_sql("reasoning")),
    **_both("sql_fence_last", text.last_sql_fence, _FENCE_SQL),
    "tag_body": (_column_query("body", lambda t: text.tag_body(t, "think")), _column_sql("body", _body_sql("think"))),
    **_both("sql_extract", text.extract_sql, _EXTRACT_SQL),
    "read_only_guard": (
        guard,
        f"WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(upper(text), '\\b({_KEYWORDS})\\b') THEN '{text.WRITE_MARKER}' ELSE text END AS c FROM documents) "
        "SELECT doc_id, md5(c) AS checked_md5, length(c) AS checked_length FROM c",
    ),
    "quote_rewrite": (
        quotes,
        "SELECT doc_id, md5(regexp_replace('SELECT `' || source || '` FROM `' || lang || '` WHERE note = ''' || text || '''', '`([^`]+)`', '\"\\1\"', 'g')) AS rewritten_md5 FROM documents",
    ),
    "identifier_list": (identifiers, IDENTIFIERS_SQL),
    "sql_blocks_removed": (
        blocks_removed,
        f"WITH {ANSWERS_SQL} SELECT doc_id, md5(regexp_replace(text, '(?s)```sql.*?```', '', 'g')) AS prose_md5 FROM answers",
    ),
    "json_choices": (
        json_choices,
        "SELECT doc_id, 0 AS sample_idx, md5(text) AS text_md5 FROM documents UNION ALL SELECT doc_id, 1, md5(source) FROM documents "
        "UNION ALL SELECT doc_id, 2, md5(lang) FROM documents",
    ),
    "completions_unwrap": (
        unwrapped,
        "SELECT doc_id, 0 AS sample_idx, md5(text) AS text_md5 FROM documents UNION ALL SELECT doc_id, 1, md5(source) FROM documents",
    ),
    "delta_assemble": (delta_assemble, DELTA_SQL),
    "time_limit": (limits, "SELECT o_orderkey, round(least(o_totalprice / 1000 * 1.2 + 10, 500), 6) AS timeout_s FROM orders"),
    "name_normalise": (
        short_names,
        "SELECT page_id, replace(replace(string_split(url || '.json', '/')[-1], '.json', ''), '.', '_') AS model_name, "
        "replace(replace(url || '.json', '.json', ''), '/', '_') AS dataset_name FROM pages",
    ),
    **_both("format_think", lambda t: formats.format_score(t, "think"), _form_sql("think", "answer")),
    **_both("format_reasoning", formats.format_score, _form_sql("reasoning", "answer")),
    **_both("format_penalty", formats.format_penalty, _form_sql("reasoning", "answer") + " - 1"),
    **_both("format_multi_tag", formats.full_form_score, _form_sql(*formats.FULL_FORM)),
    **_both("tag_count", formats.tag_count_score, f"CAST({_REWARD_SQL['tag_count']} AS DOUBLE)"),
    **_both("sql_r1_structure", formats.ordered_tags_once, _structure_sql()),
    "format_failures": (format_failures, FORMAT_FAILURES_SQL),
    "table_recall": (_recall("tables", scores.table_recall, "table_recall"), _recall_sql("tables", "`\"''", "table_recall")),
    "column_recall": (_recall("columns", scores.column_recall, "column_recall"), _recall_sql("columns", "`", "column_recall")),
    "penalty_repetition": (repetition, REPETITION_SQL),
    "penalty_not_english": (not_english, NOT_ENGLISH_SQL),
    "penalty_length": (length_penalty, LENGTH_SQL),
    "penalty_statistics": (length_stats, LENGTH_STATS_SQL),
    "reward_nl2sql": (_reward("EX"), _reward_sql(_metric_sql("bird_ex"))),
    "reward_sql_r1": (_reward("SQL-R1"), _reward_sql(_stepwise_sql("bird_ex"))),
    "reward_arctic": (_reward("arctic_sql"), _reward_sql(_run_or_match_sql("bird_ex"))),
    "reward_small": (_reward("qatch_small_update"), _reward_sql(_small_sql("cp_cr_tc"))),
    "reward_small_fm": (_reward("qatch_small_update_with_fm"), _reward_sql(_small_sql("cp_cr_tc", gated=True))),
    "reward_small_buckets": (
        _reward("qatch_small_update_fm_with_buckets"),
        _reward_sql(_small_sql("cp_cr_tc", gated=True, steps=True)),
    ),
    "reward_complex": (
        _reward("qatch_complex"),
        f"WITH {ANSWERS_SQL}, {_length_sql(_metric_sql('cp_cr_tc'))} SELECT doc_id, round(lowered, 6) AS reward FROM penalised",
    ),
    "reward_weighted": (
        weighted,
        _reward_sql(f"0.85 * {_metric_sql('bird_ex')} + 0.15 * {_form_sql('reasoning', 'answer')}"),
    ),
    "reward_scaled": (scaled, SCALED_SQL),
    "reward_registry": (all_rewards, ALL_REWARDS_SQL),
}
