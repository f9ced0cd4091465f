"""Readers, writers and shared scratch folders."""

import dataclasses
import json
from types import SimpleNamespace

import pytest

from querygrade import session
from querygrade.operators import cache
from querygrade.sources import cache_files, databases, questions, sinks


def test_read_questions(spark, tmp_path):
    rows = [{"question": "q1", "SQL": "SELECT 1", "tbls_in_query": ["t"]}, {"question": "q2\nx", "SQL": "SELECT 2", "sql_execution_time": -1}]
    (tmp_path / "q.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "q.csv").write_text('question,SQL\nq1,SELECT 1\n"q2\nx",SELECT 2\n')
    spark.createDataFrame([("q1", "SELECT 1"), ("q2\nx", "SELECT 2")], "question string, SQL string").write.parquet(f"{tmp_path}/q.parquet")
    for suffix in ("json", "jsonl", "csv", "parquet"):
        frame = questions.read_questions(spark, f"{tmp_path}/q.{suffix}", line_breaks=suffix == "csv")
        assert {(r.question, r.SQL) for r in frame.collect()} == {("q1", "SELECT 1"), ("q2\nx", "SELECT 2")}
    typed = questions.read_questions(spark, f"{tmp_path}/q.json", questions.QUESTION_SCHEMA)
    assert typed.where("sql_execution_time = -1").count() == 1 and len(typed.columns) == 8
    assert questions.read_exclusions(spark, f"{tmp_path}/q.json").columns == ["SQL"]


def test_read_split(spark, tmp_path):
    frame = spark.range(6).selectExpr("id", "if(id < 2, 'dev', 'train') AS split")
    frame.write.partitionBy("split").parquet(f"{tmp_path}/named/cfg")
    assert questions.read_split(spark, f"{tmp_path}/named", "cfg").count() == 4
    assert questions.read_split(spark, f"{tmp_path}/named/cfg", split="dev").columns == ["id"]
    frame.createOrReplaceTempView("named_dataset")
    assert questions.read_split(spark, "named_dataset", split="dev").count() == 2


def test_cache_files(spark, tmp_path):
    write = lambda rows, schema, path: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{path}")
    write([("k1", "a"), ("k2", "b")], "hash_key string, v string", "a/one")
    write([("k2", "c", 1), ("k3", "d", 2)], "hash_key string, v string, w int", "b/two")
    rows = cache_files.read_cache_files(spark, str(tmp_path))
    assert set(rows.columns) == {"hash_key", "v", "w", "source_path", "row_rank"} and rows.count() == 4
    paths = sorted(r.source_path for r in rows.select("source_path").distinct().collect())
    sources = [rows.where(rows.source_path == p).drop("source_path", "w") for p in paths]
    merged = cache.merge_caches(sources)
    assert {(r.hash_key, r.v, r.source_rank) for r in merged.collect()} == {("k1", "a", 0), ("k2", "b", 0), ("k3", "d", 1)}
    name = paths[0].split("/")[-1]
    assert cache_files.read_cache_files(spark, str(tmp_path), (name,)).count() == 2


def test_append_to_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "late"), ("a", 0, "first"), ("b", 2, "b")], "hash_key string, row_rank int, v string")
    path = f"{tmp_path}/cache"
    for _ in range(2):
        cache_files.append_to_cache(spark, rows, path)
    cache_files.append_to_cache(spark, rows.selectExpr("if(hash_key = 'b', 'c', hash_key) AS hash_key", "row_rank", "v"), path)
    assert {(r.hash_key, r.v) for r in spark.read.parquet(path).collect()} == {("a", "first"), ("b", "b"), ("c", "b")}
    assert spark.read.parquet(path).count() == 3


@dataclasses.dataclass
class Settings:
    n: int = 1
    path: object = dataclasses.field(default_factory=lambda: Settings)


def test_sinks(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("JOB_ID", raising=False)
    report = spark.createDataFrame([(1, 0.5)], "id int, score double")
    for job in ("j1", "j2", "j1"):
        sinks.save_report(report, str(tmp_path), 1, "2024-01-02", job)
    sinks.save_report(report, str(tmp_path), 4)
    saved = spark.read.json(f"{tmp_path}/report")
    assert {(r.strategy, r.job_id) for r in saved.collect()} == {("greedy", "j1"), ("greedy", "j2"), ("majority_voting", "unknown_job")}
    assert saved.count() == 3
    sinks.save_settings(spark, {"Settings": Settings(), "plain": {"a": 1}}, str(tmp_path), 1, "2024-01-02", "j1")
    stored = {r.name: json.loads(r.json) for r in spark.read.json(f"{tmp_path}/settings").collect()}
    assert stored["Settings"]["n"] == 1 and stored["plain"] == {"a": 1}


def test_shared_dir(spark):
    assert session.shared_dir(spark, "x") != session.shared_dir(spark, "x")
    on_cluster = lambda settings: SimpleNamespace(conf=SimpleNamespace(get=settings.get))
    settings = {"spark.master": "yarn", session.CHECKPOINT_SETTING: "hdfs://shared/dir/"}
    assert session.shared_dir(on_cluster(settings), "x").startswith("hdfs://shared/dir/x-")
    with pytest.raises(ValueError):
        session.shared_dir(on_cluster({"spark.master": "yarn"}), "x")


@pytest.mark.parametrize("n, name", [(1, "greedy"), (2, "majority_voting")])
def test_strategy(n, name):
    assert sinks.strategy_name(n) == name


def test_tables_right_under_a_folder(spark, tmp_path):
    root = tmp_path / "shop"
    for name in ("shop", "sales orders", "it-ems"):
        spark.range(3).write.parquet(str(root / name))
    found = databases.table_paths(spark, str(root))
    assert list(found) == ["it-ems", "sales orders", "shop"]
    session = databases.attach_database(spark, str(root))
    assert session.sql("SELECT count(*) FROM `sales orders` JOIN shop USING (id)").first()[0] == 3
