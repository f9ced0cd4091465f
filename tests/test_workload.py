"""Executed workloads, lineage by plan and by text, and a whole evaluation, on the shop database."""

from collections import defaultdict

import pytest
import shop
from pyspark.sql import functions as F

from querygrade.operators import cache, lineage
from querygrade.operators.compare import METRICS
from querygrade.plans import evaluate, plan_lineage, workload
from querygrade.sources import databases

WORK = "db_id string, sql string, timeout_s double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return shop.write(spark, tmp_path_factory.mktemp("db") / "shop")


@pytest.fixture(scope="module")
def session(spark, folder):
    return databases.attach_database(spark, folder)


@pytest.fixture(scope="module")
def catalog(spark, folder):
    return databases.catalog_rows(spark, {"shop": folder})


def grouped(frame):
    found = defaultdict(lambda: defaultdict(set))
    for r in frame.collect():
        found[r.query_id][r.table_name].add(r.column_name)
    return {q: dict(t) for q, t in found.items()}


def log_of(spark, queries):
    return spark.createDataFrame(list(queries.items()), "query_id string, sql string")


def test_catalog(catalog):
    tables = {r.table_name: r.columns for r in databases.catalog_tables(catalog).collect()}
    assert tables == {n: [c.split()[0] for c in schema.split(", ")] for n, (schema, _) in shop.TABLES.items()}
    assert databases.catalog_map(catalog).first().tables == tables


def test_views_are_private(spark, session):
    assert session.sql("SELECT count(*) FROM members").first()[0] == 4
    assert not spark.catalog.tableExists("members")


@pytest.mark.parametrize("name", list(shop.QUERIES))
def test_query_shapes(session, name):
    got = [tuple(round(v, 2) if isinstance(v, float) else v for v in r) for r in session.sql(shop.QUERIES[name]).collect()]
    assert got == shop.ROWS[name]


def test_lineage_by_text(spark, catalog):
    tables = databases.catalog_tables(catalog)
    log = log_of(spark, shop.QUERIES)
    assert grouped(lineage.used_columns(log, tables)) == shop.LINEAGE
    named = lineage.used_tables(log, tables).groupBy("query_id").agg(F.collect_set("table_name").alias("t")).collect()
    assert {r.query_id: set(r.t) for r in named} == {q: set(t) for q, t in shop.LINEAGE.items()}


def test_lineage_edges(spark, catalog):
    tables = databases.catalog_tables(catalog)
    queries = {
        "literals": "SELECT 'from plots o' FROM members -- join plots\n WHERE town = 'it''s from crops'",
        "commas": "SELECT c.name FROM members c , plots AS o, nowhere WHERE o.member_id = c.id",
        "upper": "SELECT NAME FROM MEMBERS",
        "none": "SELECT 1",
        "cte_columns": "WITH recent(u, t) AS (SELECT member_id, MAX(leased) FROM plots GROUP BY member_id) SELECT r.u FROM recent r",
        "schema": "SELECT rent FROM main.plots",
        "null": None,
    }
    assert grouped(lineage.used_columns(log_of(spark, queries), tables)) == {
        "literals": {"members": {"town"}},
        "commas": {"members": {"name", "id"}, "plots": {"member_id"}},
        "upper": {"members": {"name"}},
        "cte_columns": {"plots": {"member_id", "leased"}},
        "schema": {"plots": {"rent"}},
    }
    named = {(r.query_id, r.table_name) for r in lineage.mentioned_tables(log_of(spark, queries)).collect()}
    assert ("commas", "nowhere") in named and ("cte_columns", "recent") not in named


def test_sources_behind_brackets_and_in_quotes(spark, catalog):
    tables = databases.catalog_tables(catalog)
    wide = spark.createDataFrame([("shop", "Garden Beds", ["bed no", "a.b", "size"])], tables.schema)
    queries = {
        "derived": "SELECT x.id, plants FROM (SELECT id FROM plots WHERE rent IN (1, (2))) x, beds b JOIN (members) ON true",
        "nested": "SELECT n FROM (SELECT name AS n FROM (SELECT name FROM members) y, plots) z LEFT OUTER JOIN beds ON (z.n = 1), crops",
        "bracketed": "SELECT 1 FROM ((members m JOIN plots o ON o.member_id = m.id) CROSS JOIN beds), crops c",
        "behind_on": "SELECT 1 FROM members m JOIN plots o ON f(m.id, 1) = o.member_id, beds WHERE 1 IN (SELECT 2 FROM crops)",
        "quoted": 'SELECT g."bed no", `a.b`, "Garden Beds".size FROM "Garden Beds" g, `members`',
        "function": "SELECT EXTRACT(year FROM leased), TRIM(both FROM 'x') FROM plots, explode(ids) e WHERE rent IS DISTINCT FROM 3",
        "unbalanced": "SELECT ( FROM members",
    }
    named = lineage.mentioned_tables(log_of(spark, queries)).groupBy("query_id").agg(F.collect_set("table_name").alias("t"))
    assert {r.query_id: set(r.t) for r in named.collect()} == {
        "derived": {"plots", "beds"},
        "nested": {"members", "plots", "beds", "crops"},
        "bracketed": {"members", "plots", "beds", "crops"},
        "behind_on": {"members", "plots", "beds", "crops"},
        "quoted": {"garden beds", "members"},
        "function": {"plots"},
        "unbalanced": {"members"},
    }
    used = grouped(lineage.used_columns(log_of(spark, queries), tables.unionByName(wide)))
    assert used["quoted"] == {"Garden Beds": {"bed no", "a.b", "size"}}
    assert used["derived"]["beds"] == {"plants"} and used["derived"]["plots"] == {"id", "rent"}


def test_stars(spark, catalog):
    tables = databases.catalog_tables(catalog)
    queries = {
        "bare": "SELECT *, c.name FROM members c",
        "one": "SELECT c.*, c.name, o.rent FROM members c JOIN plots o ON o.member_id = c.id",
        "cte": "WITH x AS (SELECT id FROM plots) SELECT x.* FROM x",
        "product": "SELECT plants * seed_cost FROM beds",
        "count": "SELECT COUNT(*) FROM plots",
    }
    assert grouped(lineage.used_columns_with_stars(log_of(spark, queries), tables)) == {
        "bare": {None: {"*"}, "members": {"name"}},
        "one": {"members": {"*"}, "plots": {"rent", "member_id"}},
        "cte": {"x": {"*"}, "plots": {"id"}},
        "product": {"beds": {"plants", "seed_cost"}},
        "count": {None: {"*"}},
    }


def test_lineage_by_plan(spark, session):
    queries = {**shop.QUERIES, "broken": "SELECT nothing FROM members", "write": "DROP TABLE members"}
    plans = plan_lineage.plans_of(spark, log_of(spark, queries), session)
    found = plan_lineage.lineage_of_plans(plans)
    failed = {r.query_id for r in found.where("status <> 'ok'").collect()}
    assert failed == {"broken", "write"}
    got = grouped(found.where("status = 'ok' AND table_name IS NOT NULL"))
    assert {q: set(t) for q, t in got.items()} == {q: set(t) for q, t in shop.LINEAGE.items()}
    # The optimizer may read less than the text names, never more.
    for query, tables in got.items():
        for table, columns in tables.items():
            assert columns - {None} <= shop.LINEAGE[query][table]
    assert got["exists"] == shop.LINEAGE["exists"]


def test_run_workload(spark, session, tmp_path):
    queries = [
        "SELECT id, rent FROM plots ORDER BY rent DESC;",
        "SELECT id FROM plots WHERE id < 0",
        "SELECT missing FROM plots",
        "DELETE FROM plots",
        "SELECT 1; SELECT 2",
        "SELECT 1 AS a, 2 AS a",
        "SELECT reflect('java.lang.System', 'exit', '0')",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT 1 / 0",
    ]
    rows = [("shop", q, 100.0) for q in queries] + [("shop", queries[0], 50.0), ("other", "SELECT 1", 10.0)]
    work = spark.createDataFrame(rows, WORK)
    executions, results = workload.run_workload(spark, work, {"shop": session}, str(tmp_path), parallel=4)
    keyed = cache.with_key(work).select("hash_key", "db_id", "sql").distinct()
    got = {(r.db_id, r.sql): r for r in executions.join(keyed, "hash_key").collect()}
    assert len(got) == 10
    status = {q: got["shop", q].status for q in queries}
    assert status == dict(zip(queries, ["ok", "ok", "error", "error", "error", "ok", "error", "error", "error"]))
    assert (got["shop", queries[0]].n_rows, got["shop", queries[0]].n_cols) == (4, 2)
    assert (got["shop", queries[1]].n_rows, got["shop", queries[1]].n_cols) == (0, 1)
    assert got["shop", queries[2]].error_class.startswith("UNRESOLVED_COLUMN")
    assert got["shop", queries[8]].error_class == "DIVIDE_BY_ZERO"
    assert got["other", "SELECT 1"].error_class == "UNKNOWN_DATABASE"
    first = [r.cells for r in results.where(F.col("hash_key") == got["shop", queries[0]].hash_key).orderBy("row_idx").collect()]
    assert first == [["13.0", "120.0"], ["11.0", "80.0"], ["14.0", "60.25"], ["12.0", "45.5"]]

    again, _ = workload.run_workload(spark, work, {"shop": session}, str(tmp_path / "second"), cache=executions)
    assert again.count() == 0


def test_time_limit(spark, session, tmp_path):
    slow = "SELECT count(*) FROM range(100000000) a WHERE sha2(sha2(cast(a.id AS string), 512), 512) = 'x'"
    work = spark.createDataFrame([("shop", slow, 1.0), ("shop", "SELECT count(*) FROM plots", 60.0)], WORK)
    executions, _ = workload.run_workload(spark, work, {"shop": session}, str(tmp_path), parallel=2)
    got = {r.status: r for r in executions.collect()}
    assert set(got) == {"ok", "timeout"} and got["timeout"].error_class == "TIME_LIMIT" and got["timeout"].elapsed_ms < 30_000


def test_evaluation(spark, session, tmp_path):
    questions = spark.createDataFrame(
        [(1, "shop", "SELECT id FROM plots", 1.0), (2, "shop", "SELECT name FROM members", None), (3, "shop", "SELECT nothing", -1.0)],
        "question_id int, db_id string, SQL string, sql_execution_time double",
    )
    answers = {(1, 0): "```sql\nSELECT id FROM plots ORDER BY id DESC\n```", (1, 1): "SELECT oops", (2, 0): "SELECT name FROM members", (2, 1): "SELECT name FROM members", (3, 0): "SELECT 1", (3, 1): "SELECT 1"}
    rows = [(q, e, 0, "org/m-1.5", "data/dev.json", text) for (q, e), text in answers.items()]
    predictions = spark.createDataFrame(rows, "question_id int, experiment int, sample_idx int, model_name string, dataset_name string, text string")
    done = evaluate.evaluate_predictions(spark, questions, predictions, {"shop": session}, folder=str(tmp_path))
    summary = {r.score_name: r for r in done.summary.collect()}
    assert len(summary) == 7
    assert (summary["bird_ex"].score, summary["bird_ex"].std) == (75.0, pytest.approx(35.355))
    assert (summary["ex"].model_name, summary["ex"].dataset_name) == ("m-1_5", "data_dev")
    assert done.executions.count() == 4 and done.scores.count() == 4 * 7
    assert done.lone_questions.count() == 0 and {r.question_id for r in done.lone_predictions.collect()} == {3}
    wide = {r.question_id: r for r in done.report("m", 2).collect()}
    assert wide[1].SQL_m_1 == "SELECT oops" and wide[1].ex_m_0 == 1.0 and wide[1].ex_m_1 == 0.0
    stored = workload.read_executions(spark, str(tmp_path)), workload.read_results(spark, str(tmp_path))
    scores = lambda e: sorted((r.question_id, r.experiment, r.score_name, r.score) for r in e.scores.collect())
    assert scores(evaluate.evaluate_results(questions, predictions, *stored)) == scores(done)
    for n, part in enumerate((stored, [f.where(F.col("hash_key") < "8") for f in stored], [f.limit(0) for f in stored])):
        again = evaluate.evaluate_predictions(spark, questions, predictions, {"shop": session}, folder=str(tmp_path / f"again{n}"), cache=tuple(part))
        assert scores(again) == scores(done)


def test_evaluation_with_votes(spark, session, tmp_path):
    """Two of three samples agree on a wrong result, so the wrong one is scored."""
    questions = spark.createDataFrame([(1, "shop", "SELECT id FROM plots", 1.0)], "question_id int, db_id string, SQL string, sql_execution_time double")
    texts = ["SELECT id FROM plots", "SELECT name FROM members", "SELECT name FROM members ORDER BY name", "SELECT oops"]
    rows = [(1, 0, i, "m", "d", t) for i, t in enumerate(texts)]
    predictions = spark.createDataFrame(rows, "question_id int, experiment int, sample_idx int, model_name string, dataset_name string, text string")
    done = evaluate.evaluate_predictions(spark, questions, predictions, {"shop": session}, 4, str(tmp_path))
    assert {r.sample_idx for r in done.scores.collect()} == {1}
    assert {r.score_name: r.score for r in done.summary.collect()}["bird_ex"] == 0.0


def test_words_that_are_no_sources(spark, session):
    log = spark.createDataFrame(
        [("a", "SELECT EXTRACT(year FROM leased) FROM plots"), ("b", "SELECT trim(both FROM name) FROM members WHERE town IS NOT DISTINCT FROM name"), ("c", "SELECT substring(label from 2) FROM crops")],
        "query_id string, sql string",
    )
    got = {(r.query_id, r.table_name) for r in lineage.mentioned_tables(log).collect()}
    assert got == {("a", "plots"), ("b", "members"), ("c", "crops")}


def test_store_of_compared_pairs(spark):
    """Only pairs whose results have changed are compared again, and the metrics are those of a full comparison."""
    queries = {"a": [1, 2], "b": [2, 1], "c": [1, 2, 2], "d": [], "e": None}
    pairs = spark.createDataFrame([(f"{x}{y}", "db", x, y) for x in queries for y in queries], "pair_id string, db_id string, gold_sql string, pred_sql string")
    keyed = {r.sql: r.hash_key for r in cache.with_key(pairs.selectExpr("db_id", "gold_sql AS sql")).collect()}
    ran = spark.createDataFrame([(keyed[q], "error" if rows is None else "ok") for q, rows in queries.items() if q != "d"], "hash_key string, status string")
    ran = ran.union(spark.createDataFrame([(keyed["d"], "ok")], ran.schema))

    def results(of):
        return spark.createDataFrame([(keyed[q], i, [str(v)]) for q, rows in of.items() for i, v in enumerate(rows or [])], "hash_key string, row_idx long, cells array<string>")

    metrics = lambda frame: sorted(map(tuple, frame.select("pair_id", "both_ran", *METRICS, "cp_cr_tc").collect()))
    first = evaluate.compare_with_store(pairs, ran, results(queries)).persist()
    assert first.where("fresh").count() == 25
    same = evaluate.compare_with_store(pairs, ran, results(queries), first)
    assert same.where("fresh").count() == 0 and metrics(same) == metrics(first)
    changed = {**queries, "a": [2, 1]}  # only the order of one result
    after = evaluate.compare_with_store(pairs, ran, results(changed), first)
    assert {r.pair_id for r in after.where("fresh").collect()} == {p.pair_id for p in pairs.collect() if "a" in p.pair_id}
    assert metrics(after) == metrics(evaluate.compare_with_store(pairs, ran, results(changed)))
    lost = evaluate.compare_with_store(pairs, ran.where(F.col("hash_key") != keyed["b"]), results(queries), first)
    assert {r.pair_id for r in lost.where("fresh").collect()} == {p.pair_id for p in pairs.collect() if "b" in p.pair_id}
    first.unpersist()


def test_result_rows_are_shuffled_once(spark):
    """All metrics of an evaluation use one shuffle of the stored rows by query, and one by pair."""
    questions = spark.createDataFrame([(1, "db", "SELECT 1", 1.0)], "question_id int, db_id string, SQL string, sql_execution_time double")
    predictions = spark.createDataFrame([(1, 0, 0, "m", "d", "SELECT 2")], "question_id int, experiment int, sample_idx int, model_name string, dataset_name string, text string")
    ran = spark.createDataFrame([], "hash_key string, status string")
    results = spark.createDataFrame([], "hash_key string, row_idx long, cells array<string>")
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        summary = evaluate.evaluate_results(questions, predictions, ran, results).summary
        plan = summary._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    made = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line and "Reused" not in line]
    with_rows = [plan[i] for i in made if "cells#" in plan[i + 1]]
    of_values = [plan[i] for i in made if "is_row#" in plan[i]]
    assert len(with_rows) <= 2 and len(of_values) <= 1, [*with_rows, *of_values]


def test_lineage_looks_once_at_each_shape_of_text(spark):
    tables = spark.createDataFrame([("shop", "Sales 2023", ["net 7", "k"]), ("shop", "Sales 2024", ["net 7", "k2"])], "db_id string, table_name string, columns array<string>")
    texts = [f'SELECT "net 7" FROM "Sales {2023 + i % 2}" WHERE k = {i} AND k2 > {i}.5 AND note <> \'{i}\' -- {i}' for i in range(20)]
    texts += [f"SELECT k2 + {i} FROM `Sales 2024` LIMIT {i}" for i in range(20)] + [None, "SELECT k2 \u0005 9 FROM `Sales 2024`"]
    log = spark.createDataFrame(list(enumerate(texts)), "query_id int, sql string")
    assert lineage._shaped(log).where("sql IS NOT NULL").select("sql").distinct().count() == 4
    got = {(r.query_id, r.table_name, r.column_name) for r in lineage.used_columns(log, tables).collect()}
    old = {(i, f"Sales {2023 + i % 2}", c) for i in range(20) for c in ("net 7", "k2" if i % 2 else "k")}
    assert got == old | {(i, "Sales 2024", "k2") for i in [*range(20, 40), 41]}
    assert {r.query_id for r in lineage.used_tables(log, tables).collect()} == {q for q, _, _ in got}
