"""Streams give the batch result, also over several batches and after a restart."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from check_queries import connect
from check_queries import rows_of as check_rows
from querygrade.functions import formats
from querygrade.operators import cache, completions
from querygrade.operators.length_penalty import penalise_length
from querygrade.streaming import groups, jobs
from querygrade.suite import stream_suite

DELTA = "request int, choice int, seq int, delta string, arrived timestamp"


def source(spark, folder, schema, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder)),
        spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(folder)),
    )


def rows_of(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()))


def test_assembly(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    parts = [[(r, c, s, f"{r}-{c}-{s};", at(p)) for r in (1, 2) for c in (0, 1) for s in range(p, 3000, 3)] for p in range(3)]
    stream, batch = source(spark, tmp_path / "in", DELTA, parts)
    keys = ["request", "choice"]
    jobs.assemble_stream(stream, keys, str(tmp_path / "out")).awaitTermination()
    want = rows_of(completions.assemble_deltas(batch, keys))
    assert rows_of(jobs.read_assembled(spark, str(tmp_path / "out"), keys)) == want
    # A restart with nothing new changes nothing.
    jobs.assemble_stream(stream, keys, str(tmp_path / "out")).awaitTermination()
    assert rows_of(jobs.read_assembled(spark, str(tmp_path / "out"), keys)) == want
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).select("batch").distinct().count() == 3


def test_assembly_in_sessions(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    parts = [
        [(1, 0, 1, "b", at(0)), (1, 0, 0, "a", at(0))], [(1, 0, 3, "d", at(12)), (1, 0, 2, "c", at(5))],
        [(2, 0, 0, "x", at(30)), (1, 0, 4, "e", at(31))], [(1, 0, 5, "late", at(1)), (3, 0, 0, "z", at(59))],
    ]
    stream, _ = source(spark, tmp_path / "in", DELTA, parts)
    run = lambda: jobs.assemble_stream_until(stream, ["request", "choice"], "arrived", "1 minute", "10 minutes", str(tmp_path / "out"))
    query = run()
    query.awaitTermination()
    got = jobs.read_assembled(spark, str(tmp_path / "out"), ["request", "choice"])
    assert {(r.request, r.text) for r in got.collect()} == {(1, "abcde"), (2, "x")}
    assert jobs.late_pieces(query) == 1 and jobs.open_runs(query) == 1
    # A sign of life closes the last run and leaves nothing in state.
    spark.createDataFrame([(None, None, None, None, at(120))], DELTA).write.parquet(str(tmp_path / "in" / "sign"))
    query = run()
    query.awaitTermination()
    got = jobs.read_assembled(spark, str(tmp_path / "out"), ["request", "choice"])
    assert {(r.request, r.text) for r in got.collect()} == {(1, "abcde"), (2, "x"), (3, "z")}
    assert jobs.open_runs(query) == 0


def test_scores(spark, tmp_path):
    texts = ["<think>a</think><answer>b</answer>", "nothing", "<think>\na\n</think>\n<answer>\nb\n</answer>"]
    stream, batch = source(spark, tmp_path / "in", "id int, text string", [[(i, t)] for i, t in enumerate(texts)])
    score = lambda frame: frame.select("id", formats.format_score(F.col("text"), "think").alias("f"), formats.tag_count_score(F.col("text")).alias("t"))
    jobs.score_stream(stream, score, str(tmp_path / "out")).awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out" / "rows")).drop("batch")) == rows_of(score(batch))


def test_cache(spark, tmp_path):
    schema = "hash_key string, row_rank int, v string"
    parts = [[("a", 1, "late"), ("a", 0, "first"), ("b", 2, "b")], [("a", 3, "again"), ("c", 4, "c")], [("b", 5, "x"), ("b", 6, "y")]]
    stream, batch = source(spark, tmp_path / "in", schema, parts)
    folder = str(tmp_path / "out")
    for _ in range(2):
        jobs.append_to_cache_stream(stream, folder).awaitTermination()
        got = spark.read.parquet(f"{folder}/rows")
        assert {(r.hash_key, r.v) for r in got.collect()} == {("a", "first"), ("b", "b"), ("c", "c")} and got.count() == 3
    merged = cache.merge_caches([batch])
    assert {r.hash_key for r in merged.collect()} == {"a", "b", "c"}


def test_groups_across_batches(spark, tmp_path):
    """A group scores once it is whole, in whichever batch its last member comes; one over three batches, one without an id."""
    rows = [[(1, 10), (1, 11), (2, 5), (None, 9)], [(1, 400), (2, 6), (None, 8)], [(3, 1), (2, 7), (None, 90)]]
    big = 2**53 + 1
    parts = [[(g, n, big + n) for g, n in part] for part in rows]
    stream, batch = source(spark, tmp_path / "in", "g int, length int, big long", parts)
    folder = str(tmp_path / "out")
    score = lambda full: penalise_length(full.withColumn("score", F.lit(1.0)), "g", 3).select("g", "length", "big", "penalised")
    query = groups.score_groups_stream(stream, "g", 3, score, folder)
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/rows").drop("batch")
    key = lambda frame: sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)
    assert key(got) == key(score(batch.where("g < 3 OR g IS NULL")))
    assert [(r.g, r.length, r.big) for r in groups.read_open(spark, folder, batch.schema).collect()] == [(3, 1, big + 1)]
    # The state holds the groups that are open, not all that were seen.
    assert [n for _, n, _ in groups.open_group_counts(query)] == [3, 2, 1]


def test_groups_without_an_answer_for_long(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    parts = [[("a", 1, at(0)), ("b", 2, at(0))], [("a", 3, at(20))], [("c", 4, at(40)), ("c", 5, at(40)), ("c", 6, at(40))], [("d", 7, at(59))]]
    stream, batch = source(spark, tmp_path / "in", "g string, n int, arrived timestamp", parts)
    folder = str(tmp_path / "out")
    timed = stream.withWatermark("arrived", "0 seconds")
    query = groups.score_groups_stream(timed, "g", 2, lambda closed: closed, folder, patience=900, arrival="arrived")
    query.awaitTermination()
    got = {(r.g, r.n, r.arrived, r.complete) for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {("a", 1, at(0), True), ("a", 3, at(20), True), ("b", 2, at(0), False), *(("c", n, at(40), True) for n in (4, 5, 6))}
    assert [r.n for r in groups.read_open(spark, folder, batch.schema).collect()] == [7]


@pytest.mark.parametrize("bits", [0, 2])
def test_state_holds_ranges_of_groups(spark, tmp_path, bits):
    """The entries of the state, and so the calls of Python, are the ranges of the hash and not the groups; rows stay the same."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    parts = [
        [(g / 2, n, at(0)) for g in range(60) for n in range(3 if g < 20 else 1)] + [(None, 0, at(0)), (-0.0, 90, at(0))],
        [(g / 2, 7, at(20)) for g in range(20, 40)] + [(None, 7, at(20))], [(99.0, 8, at(40)), (99.5, 8, None)],
    ]
    stream, batch = source(spark, tmp_path / "in", "g double, n int, arrived timestamp", parts)
    folder = str(tmp_path / "out")
    timed = stream.withWatermark("arrived", "0 seconds")
    query = groups.score_groups_stream(timed, "g", 2, lambda closed: closed, folder, patience=900, arrival="arrived", bits=bits)
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/rows")
    of = lambda frame: sorted({r.g for r in frame.collect()}, key=repr)
    assert of(got.where("complete")) == sorted([None, *(g / 2 for g in range(40))], key=repr)
    assert of(got.where("NOT complete")) == sorted([*(g / 2 for g in range(40, 60)), 99.5], key=repr)
    assert got.where("g = 0").count() == 4 and of(groups.read_open(spark, folder, batch.schema)) == [99.0]
    assert got.count() + 1 == batch.count()
    counts = [n for _, n, _ in groups.open_group_counts(query)]
    assert counts[0] == 41 and counts[1] == 20 and counts[-1] == 1
    assert all(s["numRowsTotal"] <= 2**bits for p in query.recentProgress for s in p["stateOperators"])


def test_waiting_by_the_clock():
    """Without event times a group that is silent for too long leaves by the clock, and its neighbours in the state stay."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
    from pyspark.sql.types import StructType

    closing = groups._closing(2, 8, False)

    def call(now, rows, value, timed_out=False):
        state = GroupState(value, now, -1, GroupStateTimeout.ProcessingTimeTimeout, timed_out, False, value is not None, False, False, -1, b"", StructType())
        out = list(closing((0,), iter([pd.DataFrame(rows, columns=["name", "answer"])]), state))
        return [tuple(r) for f in out for r in f.values.tolist()], state

    out, state = call(1000, [("a", "1"), ("b", "2")], None)
    assert out == [] and state._timeout_timestamp == 9000
    out, state = call(5000, [("c", "3")], state.get)
    assert out == [] and state._timeout_timestamp == 9000
    # The silent one leaves, the one that is met goes on although it was silent for as long.
    out, state = call(9001, [("b", "4"), ("b", "5")], state.get)
    assert sorted(out) == [("1", False), ("2", True), ("4", True), ("5", True)] and state._timeout_timestamp == 13000
    out, state = call(13001, [], state.get, timed_out=True)
    assert out == [("3", False)] and not state.exists


def test_untouched_parts_of_the_cache_are_not_read(spark, tmp_path):
    schema = "hash_key string, row_rank int, v string"
    first = [(f"k{i}", i, "first") for i in range(200)] + [(None, i, "keyless") for i in range(20)]
    second = [("k7", 300, "again"), ("k8", 301, "again"), ("new", 302, "new")]
    stream, _ = source(spark, tmp_path / "in", schema, [first, second])
    folder = str(tmp_path / "out")
    jobs.append_to_cache_stream(stream, folder, bits=4).awaitTermination()
    rows = jobs.read_cache(spark, folder)
    assert rows.count() == 221 and rows.where("v = 'again'").count() == 0
    touched = [r.part for r in spark.createDataFrame(second, schema).select(jobs.cache_part(4).alias("part")).distinct().collect()]
    known = jobs.known_keys(spark, folder, 1, touched)
    known.collect()
    scan = known._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numPartitions").value()
    assert 0 < len(touched) < 16 and read == len(touched)
    assert spark.read.parquet(f"{folder}/rows").where("batch = 0").select("part").distinct().count() == 16


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not there")
@pytest.mark.parametrize("files", [None, 1, 3])
def test_registered_streams_read_files_and_folders(spark, tmp_path, files):
    """A table is one file, or a folder of any number of files."""
    source = "/root/testdata/sf0.001"
    for name in ("documents", "conversations"):
        if files is None:
            shutil.copy(f"{source}/{name}.parquet", tmp_path / f"{name}.parquet")
        else:
            spark.read.parquet(f"{source}/{name}.parquet").repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_assemble", "stream_score"):
        query, sql = stream_suite.QUERIES[name]
        frame = query(spark, str(tmp_path))
        cursor = connect(source).execute(sql)
        got = check_rows(frame.columns, [tuple(r) for r in frame.collect()])
        assert got == check_rows([d[0] for d in cursor.description], cursor.fetchall()), name
