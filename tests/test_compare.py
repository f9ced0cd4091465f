"""Result comparison against plain Python on small random tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querygrade.functions.cells import canonical_cell, cell_key, row_key
from querygrade.operators import compare

RESULT = "pair_id string, side string, row_idx bigint, cells array<string>"
RAN = "pair_id string, pred_ok boolean, gold_ok boolean"


def expected(pred, gold):
    """The published definitions, row by row."""
    names = (*compare.METRICS, compare.COMBINED)
    if not pred and not gold:
        return dict.fromkeys(names, 1.0)
    if not pred or not gold:
        return dict.fromkeys(names, 0.0)
    p, t = Counter(pred), Counter(gold)
    pc, tc = [c for r in pred for c in r], [c for r in gold for c in r]
    shared = [r for r in p if r in t]
    order = 0.0
    if len(shared) == 1:
        order = 1.0
    elif shared:
        by_pred, by_gold = sorted(shared, key=pred.index), sorted(shared, key=gold.index)
        gaps = sum((by_pred.index(r) - by_gold.index(r)) ** 2 for r in shared)
        n = len(shared)
        order = (2 - 6 * gaps / (n * (n * n - 1))) / 2
    result = {
        "cell_precision": sum(c in set(tc) for c in pc) / len(pc),
        "cell_recall": sum(c in set(pc) for c in tc) / len(tc),
        "tuple_cardinality": min(len(pred), len(gold)) / max(len(pred), len(gold)),
        "tuple_constraint": sum(p[r] == t[r] for r in t) / len(t),
        "tuple_order": order,
        "bird_ex": float(set(p) == set(t)),
        "ex": float(p == t),
    }
    result[compare.COMBINED] = sum(result[m] for m in ("cell_precision", "cell_recall", "tuple_cardinality")) / 3
    return result


def frames(spark, pairs, step=1):
    rows, ran = [], []
    for name, (pred, gold) in pairs.items():
        ran.append((name, pred is not None, gold is not None))
        for side, table in (("pred", pred), ("gold", gold)):
            rows += [(name, side, i * step, list(r)) for i, r in enumerate(table or [])]
    return spark.createDataFrame(rows, RESULT), spark.createDataFrame(ran, RAN)


def check(spark, pairs, step=1):
    got = {r.pair_id: r.asDict() for r in compare.compare_results(*frames(spark, pairs, step)).collect()}
    assert set(got) == set(pairs)
    for name, (pred, gold) in pairs.items():
        want = dict.fromkeys(compare.METRICS, 0.0) if pred is None or gold is None else expected(pred, gold)
        for metric, value in want.items():
            assert got[name][metric] == pytest.approx(value), (name, metric, pred, gold)


def test_edge_pairs(spark):
    one = [("a", "b")]
    check(spark, {
        "same": (one, one), "both_empty": ([], []), "pred_empty": ([], one), "gold_empty": (one, []),
        "pred_failed": (None, one), "gold_failed": (one, None), "doubled": (one * 2, one), "nothing_shared": ([("x",)], one),
        "reversed": ([("a",), ("b",), ("c",)], [("c",), ("b",), ("a",)]), "null_is_not_empty": ([(None,)], [("",)]),
        "cells_do_not_run_together": ([("a", "")], [("", "a")]), "fewer_columns": ([("a",)], one),
        "long_cells": ([("x" * 500, "y")], [("x" * 500, "y")]),
    })


@pytest.mark.parametrize("step", [1, 40_000])
def test_random_pairs(spark, step):
    """Positions far apart fall into many rank blocks and must give the same ranks."""
    rng = random.Random(step)
    table = lambda: [(rng.choice("abc"), rng.choice(["1", "2", None])) for _ in range(rng.randrange(9))]
    check(spark, {f"p{i}": (table(), table()) for i in range(60)}, step)


def test_match_does_not_depend_on_row_order(spark):
    rng = random.Random(5)
    pairs = {}
    for i in range(20):
        gold = [(rng.choice("abcd"),) for _ in range(rng.randrange(1, 8))]
        pairs[str(i)] = (rng.sample(gold, len(gold)), gold)
    got = compare.compare_results(*frames(spark, pairs)).collect()
    assert all(r.bird_ex == r.ex == r.cell_precision == 1.0 for r in got)


def test_one_shuffle_serves_both_branches(spark):
    rows, ran = frames(spark, {"a": ([("1",)], [("1",)])})
    result = compare.compare_results(rows, ran)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_majority_vote(spark):
    candidates = [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, False), (3, 0, True), (3, 1, True), (4, 0, False), (4, 1, True)]
    rows = [(1, 0, ["x"]), (1, 1, ["a"]), (1, 1, ["b"]), (1, 2, ["b"]), (1, 2, ["a"]), (1, 2, ["a"]), (3, 0, ["p"]), (3, 1, ["q"])]
    got = compare.majority_vote(
        spark.createDataFrame(candidates, "question_id int, sample_idx int, ok boolean"),
        spark.createDataFrame(rows, "question_id int, sample_idx int, cells array<string>"),
    )
    assert {(r.question_id, r.sample_idx, r.votes) for r in got.collect()} == {(1, 1, 2), (2, 0, 0), (3, 0, 1), (4, 1, 1)}


def test_canonical_cells(spark):
    frame = spark.sql("SELECT 1 AS i, 1.0D AS d, -0.0D AS z, true AS b, 1.00BD AS m, 'A' AS s, DATE'2024-01-02' AS t, null AS n, array(1) AS a, 0.1234567D AS r")
    cells = frame.select(*[canonical_cell(F.col(f.name), f.dataType).alias(f.name) for f in frame.schema.fields]).first()
    assert cells.i == cells.d == cells.b == cells.m
    assert (cells.z, cells.s, cells.t, cells.n, cells.a, cells.r) == ("0.0", "A", "2024-01-02", None, "[1]", "0.123457")


def test_large_whole_numbers_keep_their_digits(spark):
    frame = spark.sql("SELECT explode(array(9223372036854775806, 9223372036854775807, -9223372036854775808, null, 7)) AS n")
    cells = [r.c for r in frame.select(canonical_cell(F.col("n"), frame.schema["n"].dataType).alias("c")).collect()]
    assert cells == ["9223372036854775806", "9223372036854775807", "-9223372036854775808", None, "7.0"]


def test_keys_are_bounded_and_distinct(spark):
    frame = spark.createDataFrame([(["a" * 300],), (["a" * 301],), ([None],), ([""],), (["N"],)], "cells array<string>")
    keys = [r.k for r in frame.select(row_key(F.col("cells")).alias("k")).collect()]
    assert len(set(keys)) == 5 and max(map(len, keys)) <= 64
    assert frame.select(cell_key(F.col("cells")[0]).alias("k")).distinct().count() == 5


def test_decimals_keep_their_digits(spark):
    from pyspark.sql import types as T

    from querygrade.functions.cells import canonical_cell

    frame = spark.createDataFrame([("12345678901234567890.1234567",), ("12345678901234567891.1234567",), ("1.50",), ("100",), ("0",)], "s string")
    kind = T.DecimalType(30, 8)
    got = [r[0] for r in frame.select(canonical_cell(F.col("s").cast(kind), kind)).collect()]
    assert got == ["12345678901234567890.123457", "12345678901234567891.123457", "1.5", "100.0", "0.0"]


def test_large_pairs_are_compared_alike(spark):
    """Pairs that are spread over their values have the metrics of those that one task compares."""
    rng = random.Random(5)
    rows = [(f"p{p}", side, i * 100_000, [rng.choice("abc"), rng.choice("xy")]) for p in range(8) for side in ("pred", "gold") for i in range(p * 3)]
    results = spark.createDataFrame(rows, RESULT)
    ran = spark.createDataFrame([(f"p{p}", True, True) for p in range(8)], RAN)
    all_of = lambda limit: sorted(map(tuple, compare.compare_results(results, ran, whole_pairs=limit).collect()))
    assert all_of(0) == all_of(20) == all_of(1 << 20)
