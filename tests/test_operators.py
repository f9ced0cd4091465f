"""Sampling, curation, prompts, reports, caches, group penalties and rewards."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from querygrade.operators import cache, completions, curate, language, prompts, report, rewards, sampling
from querygrade.operators.length_penalty import penalise_length, penalty_statistics
from querygrade.sources import cache_files


def ids(frame, column="id"):
    return {r[0] for r in frame.select(column).collect()}


# --- sampling --------------------------------------------------------------------------------


@pytest.mark.parametrize("n, weight", [(0, 0.5), (1, 0.5), (7, 0.3), (100, 1.0), (100, 0.0), (999, 0.37)])
def test_subsample_is_exact(spark, n, weight):
    taken = ids(sampling.subsample(spark.range(n), "id", 3, weight))
    assert len(taken) == int(n * weight) and taken <= set(range(n))


def test_subsample_takes_the_smallest_hashes(spark):
    import hashlib

    order = sorted(range(200), key=lambda i: hashlib.md5(f"9-{i}".encode()).hexdigest())
    assert ids(sampling.subsample(spark.range(200), "id", 9, 0.25)) == set(order[:50])
    assert [r.id for r in sampling.shuffled(spark.range(200), "id", 9).collect()] == order


def test_rows_without_id_have_a_place(spark):
    frame = spark.createDataFrame([(i if i % 3 else None, i) for i in range(30)], "id int, v int")
    assert sampling.subsample(frame, "id", 1, 1.0).count() == 30
    half = [r.v for r in sampling.subsample(frame, "id", 1, 0.5).collect()]
    assert len(half) == 15 and any(v % 3 == 0 for v in half)
    for weight in (-0.1, 1.5):
        with pytest.raises(ValueError):
            sampling.subsample(frame, "id", 1, weight)


def test_scaled_rewards_keep_rows_without_group(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, 3.0), (None, 5.0), (None, 7.0)], "prompt int, reward double")
    got = sorted(r.scaled for r in rewards.scale_rewards(frame, "reward", "prompt", "none").collect())
    assert got == [-1.0, -1.0, 1.0, 1.0]


def test_words_stay_apart_in_a_large_vocabulary(spark):
    words = spark.range(70_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    known = words.withColumn("lang", F.when(F.col("text").endswith("a"), "en").otherwise("fr"))
    profile = language.language_profile(known, "text", "lang", ["en", "fr"])
    assert profile.count() == 70_000 and profile.where("en > 0 and fr > 0").count() == 0


def test_split_is_disjoint_and_complete(spark):
    parts = sampling.train_test_split(spark.range(101), "id", 1, 0.2)
    train, test = ids(parts["train"]), ids(parts["test"])
    assert len(test) == math.ceil(101 * 0.2) and not train & test and train | test == set(range(101))


def test_subsets_are_nested(spark):
    rows = sampling.with_smallest_subset(spark.range(320), "id", 4).collect()
    for step in range(1, 6):
        inside = {r.id for r in rows if r.subset >= step}
        assert len(inside) == 320 >> step
        assert inside == ids(sampling.subsample(spark.range(320), "id", 4, 2.0**-step))


# --- curation --------------------------------------------------------------------------------


def test_filters(spark):
    frame = spark.createDataFrame([(1, -1.0, "a"), (2, None, None), (3, 2.0, "b")], "id int, sql_execution_time double, SQL string")
    assert ids(curate.drop_bad_gold(frame)) == {2, 3}
    wrong = spark.createDataFrame([("a",), ("a",), (None,)], "SQL string")
    assert ids(curate.exclude_listed(frame, wrong)) == {2, 3}
    kept, before, after = curate.counted_filter(frame, F.col("id") > 1)
    assert kept.count() == 2 and (before.get["rows"], after.get["rows"]) == (3, 2)
    assert curate.training_columns(frame).columns == ["id", "sql_execution_time", "target_sql"]
    assert curate.replicate(frame.select("id"), 3).count() == 9
    assert ids(curate.unmatched(frame, frame.where("id = 1"), ["id"])) == {2, 3}


def test_mixture(spark, tmp_path):
    for name, start in (("a", 0), ("b", 100)):
        spark.range(start, start + 40).selectExpr("id", "id AS x", "if(id % 4 = 0, 'test', 'train') AS split").write.parquet(f"{tmp_path}/{name}/cfg")
    part = lambda name, weight: curate.MixturePart(f"{tmp_path}/{name}", "cfg", "train", ["id"], weight)
    mixture = curate.Mixture([part("a", 0.5), part("b", None)], seed=7, test_split_size=0.1)
    splits = curate.load_mixture(spark, mixture, "id")
    train, test = ids(splits["train"]), ids(splits["test"])
    assert len(train) + len(test) == 45 and len(test) == 5 and not train & test
    assert sum(i < 100 for i in train | test) == 15
    with pytest.raises(ValueError):
        curate.Mixture([curate.MixturePart("a", columns=["x"]), curate.MixturePart("b", columns=["y"])])
    with pytest.raises(ValueError):
        curate.union_all([spark.range(1), spark.range(1).toDF("y")])
    with pytest.raises(ValueError):
        curate.load_mixture(spark, curate.Mixture(), "id")


def test_enrich(spark):
    questions = spark.createDataFrame([(1,), (2,)], "query_id int")
    lineage = spark.createDataFrame([(1, "t", "b"), (1, "t", "a"), (1, "u", None)], "query_id int, table_name string, column_name string")
    ran = spark.createDataFrame([(1, "ok", 1500), (2, "error", 3)], "query_id int, status string, elapsed_ms bigint")
    got = {r.query_id: r for r in curate.enrich_with_labels(questions, lineage, ran, "query_id").collect()}
    assert got[1].tbls_in_query == ["t", "u"] and got[1].cols_in_query == ["t.a", "t.b"] and got[1].sql_execution_time == 1.5
    assert got[2].tbls_in_query is None and got[2].sql_execution_time == -1


def test_many_parts_are_counted_together(spark):
    """Exact numbers of every part, also of equal rows without an id."""
    numbered = spark.range(101).selectExpr("id", "'a' AS v")
    equal = spark.range(50).selectExpr("CAST(NULL AS LONG) AS id", "'same' AS v")
    mixed = equal.union(spark.range(1000, 1007).selectExpr("id", "'b' AS v"))
    parts = [(numbered, 0.5), (equal, 0.3), (mixed, 0.5), (numbered, None), (equal, 0.0), (equal, 1.0)]
    taken = sampling.subsample_parts(parts, "id", 7)
    assert [t.count() for t in taken] == [50, 15, 28, 101, 0, 50]
    assert ids(taken[0]) == ids(sampling.subsample(numbered, "id", 7, 0.5))
    assert ids(sampling.subsample(numbered, "id", 7, 0.25)) < ids(taken[0])
    with pytest.raises(ValueError):
        sampling.subsample_parts([(numbered, 1.5)], "id", 7)


# --- prompts ---------------------------------------------------------------------------------


def test_render(spark, tmp_path):
    (tmp_path / "user.txt").write_text("Q: {{ question }}\nE: {{evidence}}  \n\n")
    template = prompts.read_template("user.txt", str(tmp_path))
    assert prompts.template_variables(template) == ["question", "evidence"]
    frame = spark.createDataFrame([("a {{ evidence }} \\", None), ("b", "c")], "question string, evidence string")
    assert [r.p for r in frame.select(prompts.render(template).alias("p")).collect()] == ["Q: a {{ evidence }} \\\nE: None\n", "Q: b\nE: c\n"]
    with pytest.raises(Exception, match="evidence"):
        frame.drop("evidence").select(prompts.render(template)).schema


def test_messages(spark):
    frame = spark.createDataFrame([("q", "SELECT 1")], "question string, SQL string")
    row = prompts.build_messages(frame, "{{ question }}|{{ evidence }}", "be brief", "SQL").first()
    assert [(m.role, m.content) for m in row.prompt] == [("system", "be brief\n"), ("user", "q|\n")]
    assert [(m.role, m.content) for m in row.completion] == [("assistant", "SELECT 1")]
    assert "completion" not in prompts.build_messages(frame, "x").columns
    assert len(prompts.build_messages(frame, "x", "").first().prompt) == 1


# --- completions -----------------------------------------------------------------------------


def test_choices_and_deltas(spark):
    frame = spark.createDataFrame([(1, '{"choices": [{"index": 0, "message": {"role": "assistant", "content": "a"}}, {"message": {"content": "b"}}]}')], "id int, response string")
    assert [(r.sample_idx, r.text) for r in completions.choices_of_responses(frame).collect()] == [(0, "a"), (1, "b")]
    pieces = [(r, c, s, None if s == 2 else f"{r}{c}{s};") for r in (1, 2) for c in ("x", "y") for s in range(5000 if (r, c) == (1, "x") else 4)]
    got = completions.assemble_deltas(spark.createDataFrame(pieces, "r int, c string, seq int, delta string").repartition(5), ["r", "c"])
    for row in got.collect():
        assert row.text == "".join(d or "" for r, c, _, d in pieces if (r, c) == (row.r, row.c))


# --- reports ---------------------------------------------------------------------------------


def test_summary(spark):
    runs = {0: [1.0, 0.0], 1: [1.0, 1.0], 2: [0.0, 0.0]}
    rows = [(1, "m", "d", "ex", e, i, s) for e, scores in runs.items() for i, s in enumerate(scores)] + [(1, "m", "d", "bird_ex", 0, 0, 0.5)]
    frame = spark.createDataFrame(rows, "number_of_completions int, model_name string, dataset_name string, score_name string, experiment int, id int, score double")
    got = {r.score_name: (r.score, r.std) for r in report.summarise(frame).collect()}
    means = [statistics.mean(s) for s in runs.values()]
    assert got == {"ex": (50.0, round(statistics.stdev(means) * 100, 3)), "bird_ex": (50.0, 0.0)}
    wide = report.wide_report(frame.where("score_name = 'ex'"), "id", "m", 3, {"ex": "score"})
    assert {r.id: (r.ex_m_0, r.ex_m_1, r.ex_m_2) for r in wide.collect()} == {0: (1, 1, 0), 1: (0, 1, 0)}
    board = report.leaderboard(report.summarise(frame.union(frame.withColumn("model_name", F.lit("n")).withColumn("score", F.lit(0.1)))))
    assert {(r.model_name, r.score_name): r.place for r in board.collect()}[("n", "ex")] == 2


# --- caches ----------------------------------------------------------------------------------


def test_merge(spark):
    a = spark.createDataFrame([("k1", 0, "a1", 1), ("k2", 1, "a2", 2), ("k2", 2, "later", 3), (None, 3, "n1", 4), (None, 4, "n2", 5)], "hash_key string, row_rank int, v string, w int")
    b = spark.createDataFrame([("k3", 0, "b3"), ("k1", 1, "b1")], "hash_key string, row_rank int, v string")
    merged = cache.merge_caches([a, b])
    key = lambda r: (r.hash_key or "", r.v)
    assert sorted(map(key, merged.collect())) == [("", "n1"), ("", "n2"), ("k1", "a1"), ("k2", "a2"), ("k3", "b3")]
    assert {r.source_rank: r.inserted for r in cache.inserted_per_source(merged).collect()} == {0: 4, 1: 1}
    stored = merged.where("hash_key is not null").drop("source_rank")
    again = cache.merge_caches([a.where("hash_key is not null"), b], existing=stored)
    assert cache.inserted_per_source(again).count() == 0 and again.count() == 3
    existing = spark.createDataFrame([("k1", "old")], "hash_key string, v string")
    got = cache.merge_caches([a.where("hash_key is not null"), b], existing=existing)
    assert got.columns == ["hash_key", "source_rank", "v"]
    assert {r.hash_key: (r.source_rank, r.v) for r in got.collect()} == {"k1": (-1, "old"), "k2": (0, "a2"), "k3": (1, "b3")}
    assert cache.new_rows(a, merged).where("hash_key is not null").count() == 0
    assert ids(cache.new_rows(a, existing).where("hash_key is not null"), "v") == {"a2"}


def test_merge_of_files(spark, tmp_path):
    """Any number of files in one scan: the first path and row of a key win, existing rows before all."""
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    write("b", [("k1", "b1"), ("k3", "b3")], "hash_key string, v string")
    write("a", [("k1", "a1", 1), ("k2", "a2", 2), ("k2", "later", 3), (None, "n1", 4), (None, "n2", 5)], "hash_key string, v string, w int")
    write("c", [("k4", 7)], "hash_key string, w int")
    rows = cache_files.read_cache_files(spark, str(tmp_path))
    merged = cache.merge_cache_rows(rows)
    assert merged.columns == ["hash_key", "source_path", "v", "w"]
    got = {(r.hash_key, r.v, r.w, r.source_path.split("/")[-2]) for r in merged.collect()}
    assert got == {("k1", "a1", 1, "a"), ("k2", "a2", 2, "a"), ("k3", "b3", None, "b"), ("k4", None, 7, "c"), (None, "n1", 4, "a"), (None, "n2", 5, "a")}
    existing = spark.createDataFrame([("k1", "old"), ("k9", "kept")], "hash_key string, v string")
    got = {(r.hash_key, r.v, r.source_path is None) for r in cache.merge_cache_rows(rows, existing).where("hash_key IS NOT NULL").collect()}
    assert got == {("k1", "old", True), ("k9", "kept", True), ("k2", "a2", False), ("k3", "b3", False), ("k4", None, False)}
    plan = merged.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_counts_of_a_filter(spark, tmp_path):
    kept, counts = curate.save_filtered(spark.range(10).toDF("id"), F.col("id") > 6, f"{tmp_path}/kept")
    assert ids(kept) == {7, 8, 9} and {tuple(r) for r in counts.collect()} == {("before", 10), ("after", 3)}


def test_lookup(spark):
    work = spark.createDataFrame([("d", "SELECT 1"), ("d", "SELECT 2"), ("e", "SELECT 1")], "db_id string, sql string")
    stored = cache.with_key(work.where("db_id = 'e'"))
    hits, misses = cache.cache_hits(cache.with_key(work), stored), cache.cache_misses(cache.with_key(work), stored)
    assert (hits.count(), misses.count()) == (1, 2)


# --- group penalty and rewards ---------------------------------------------------------------


def expected_penalty(group, generations, strength):
    correct = [n for s, n in group if s > 0.5]
    if len(group) < generations or len(correct) < 2:
        return [s for s, _ in group]
    avg = statistics.mean(correct)
    spread = max(statistics.stdev(correct), 0.2 * avg)
    z = [(n - avg) / spread for _, n in group]
    return [max(0.0, s - min(0.9, strength * v)) if s > 0 and v > 0 else s for (s, _), v in zip(group, z)]


def test_length_penalty(spark):
    groups = {
        1: [(1.0, 10), (1.0, 12), (1.0, 400), (0.3, 900)],
        2: [(1.0, 10), (0.2, 500), (0.0, 20), (0.5, 30)],
        3: [(1.0, 10), (1.0, 500)],
        4: [(0.6, 10), (0.7, 10), (0.05, 5000), (-1.0, 9000)],
    }
    rows = [(g, i, float(s), n) for g, members in groups.items() for i, (s, n) in enumerate(members)]
    frame = spark.createDataFrame(rows, "g int, i int, score double, length int")
    got = {(r.g, r.i): r.penalised for r in penalise_length(frame, "g", 4).collect()}
    for g, members in groups.items():
        assert [got[g, i] for i in range(len(members))] == pytest.approx(expected_penalty(members, 4, 0.1))
    stats = {r.g: r for r in penalty_statistics(frame, "g", 4).collect()}
    assert set(stats) == {1, 4} and stats[4].spread == pytest.approx(2.0) and stats[4].mean_penalty == pytest.approx(0.9)


def test_language(spark):
    known = [("the cat sat on the mat and the dog", "en"), ("le chat est sur la table et le chien", "fr")] * 5
    profile = language.language_profile(spark.createDataFrame(known, "text string, lang string"), "text", "lang", ["en", "fr"])
    texts = ["the dog and the cat sat on the mat the cat", "le chien et le chat sur la table le chat est", "a", None, "12345 67890",
             "le chat est sur ```sql the the the``` la table et le chien et le chat", "   \n    \n"]
    answers = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.penalty for r in language.foreign_language_penalty(answers, "id", "text", profile, ["en", "fr"], threshold=0.6).collect()}
    assert got == {0: 0.0, 1: -1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: -1.0, 6: 0.0}


def test_language_scores_read_the_texts_once(spark, tmp_path):
    answers = spark.createDataFrame([(i, "the cat " * 9) for i in range(20)], "id int, text string")
    answers.write.parquet(f"{tmp_path}/answers")
    language.language_profile(answers.withColumn("lang", F.lit("en")), "text", "lang", ["en", "fr"]).write.parquet(f"{tmp_path}/profile")
    profile = spark.read.parquet(f"{tmp_path}/profile")
    found = language.foreign_language_penalty(spark.read.parquet(f"{tmp_path}/answers"), "id", "text", profile, ["en", "fr"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("/answers") <= 1 and plan.count("text#") >= 1
    assert found.count() == 20


def test_registry(spark):
    assert len(rewards.REWARD_NAMES) == 23
    form = "<think>\na\n</think>\n<answer>\nSELECT 1\n</answer>"
    rows = [(p, i, form + "x" * 0, True, 1.0, 1.0, 0.4) for p in (1, 2) for i in range(2)]
    frame = spark.createDataFrame(rows, "prompt_id int, i int, text string, both_ran boolean, bird_ex double, ex double, cp_cr_tc double")
    frame = frame.withColumns({"tbls_in_query": F.array(F.lit("t")), "cols_in_query": F.array(F.lit("t.c")), "token_ids": F.array(F.lit(1)), "answer_id": F.concat_ws("-", "prompt_id", "i")})
    known = spark.createDataFrame([("le chat est la", "fr"), ("the cat is here", "en")], "text string, lang string")
    profile = rewards.LanguageProfile(language.language_profile(known, "text", "lang", ["en", "fr"]), ["en", "fr"])
    named = rewards.named_rewards(frame, " ".join(rewards.REWARD_NAMES), "prompt_id", 2, "answer_id", profile)
    assert named.count() == 4 and set(rewards.REWARD_NAMES) < set(named.columns)
    row = named.first().asDict()
    assert (row["EX"], row["QATCH"], row["format_think"], row["format"], row["penalty_no_format"], row["qatch_complex"]) == (1, 0.4, 1, 0, -1, 0.4)
    french = rewards.named_rewards(frame.withColumn("text", F.lit("le chat est la le chat")), "penalty_not_english EX", key="answer_id", profile=profile)
    assert {(r.penalty_not_english, r.EX) for r in french.collect()} == {(-1.0, 1.0)}
    with pytest.raises(KeyError):
        rewards.named_rewards(frame, "EX nothing")
    with pytest.raises(ValueError):
        rewards.named_rewards(frame, "penalty_not_english")
    with pytest.raises(ValueError):
        rewards.weighted_sum({"a": F.lit(1)}, {"b": 1.0})


@pytest.mark.parametrize("by", ["group", "batch", "none"])
def test_scaling(spark, by):
    values = {1: [1.0, 0.0, 0.5], 2: [0.2, 0.2]}
    rows = [(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)]
    got = {(r.g, r.i): r.scaled for r in rewards.scale_rewards(spark.createDataFrame(rows, "g int, i int, r double"), "r", "g", by).collect()}
    everything = [v for vs in values.values() for v in vs]
    for g, vs in values.items():
        spread = {"group": statistics.stdev(vs) + 1e-4, "batch": statistics.stdev(everything) + 1e-4, "none": 1.0}[by]
        assert [got[g, i] for i in range(len(vs))] == pytest.approx([(v - statistics.mean(vs)) / spread for v in vs])


def test_few_words_of_a_text_are_shuffled(spark):
    """Of texts whose words come up alike, one in 3000 each, no word goes into a shuffle of its own."""
    profile = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.lit(10).alias("en"), F.lit(0).alias("fr"))
    assert profile.where(language.common_word(["en", "fr"], 30_000.0)).count() == 3000
    assert profile.where(language.common_word(["en", "fr"], 30_000_000.0)).count() == 0


def test_rewards_carry_no_texts_through_shuffles(spark):
    answers = spark.range(4).select("id", (F.col("id") % 2).alias("prompt"), F.concat(F.lit("the end of it "), "id").alias("text"), F.lit(True).alias("both_ran"), (F.col("id") / 4).alias("bird_ex"))
    profile = rewards.LanguageProfile(spark.createDataFrame([("the", 9, 0), ("fin", 0, 9)], "word string, en long, fr long"), ["en", "fr"])
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        named = rewards.named_rewards(answers, "penalty_not_english ex_complex format", "prompt", 2, "id", profile)
        assert named.columns == [*answers.columns, "format", "penalty_not_english", "ex_complex"]
        plan = named.agg(F.avg("format"), F.avg("ex_complex"), F.avg("penalty_not_english"))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sent = [line for above, line in zip(plan, plan[1:]) if "Exchange hashpartitioning" in above]
    assert sent and not [line for line in sent if " AS text#" in line or ", text#" in line], "\n".join(plan)
