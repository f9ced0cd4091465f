"""Answer parsing, format scores, recall, penalties and reward formulas on single texts."""

import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querygrade.functions import formats, scores, text

FORM = "<think>\nwhy\n</think>\n<answer>\nSELECT 1\n</answer>"
FULL = (
    "<reasoning>\nBeds of `garden plots` are counted by kind.\n</reasoning>\n<tables>\ngarden plots, seed kinds\n</tables>\n"
    "<columns>\ngarden plots.`bed count`, garden plots._kind, seed kinds.label\n</columns>\n<checks>\n1. one row a kind\n</checks>\n"
    "<answer>\nSELECT label FROM `seed kinds`\n</answer>\n"
)


def column(spark, build, rows, schema="text string"):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in frame.select("i", build.alias("v")).orderBy("i").collect()]




@pytest.fixture(autouse=True)
def _session(spark):
    globals()["T"] = F.col("text")


def test_strip_removes_what_python_strips():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert all(re.fullmatch(text.WHITESPACE_CLASS, c) for c in text.WHITESPACE)


def test_tag_body(spark):
    got = column(spark, text.tag_body(T, "a"), [
        "x<a>\n one \n</a>\n<a>\ntwo\n</a>", "<a>\n\n</a>", "<a>\n</a>", "<a>one</a>", "none", None, "<a>\n1\n2\n</a>", "<a>\nopen", "\n</a><a>\nz",
    ])
    assert got == ["one", "", None, None, None, None, "1\n2", None, None]


def test_fence_and_extract(spark):
    rows = [
        "```sql\nA\n``` then ```sql B ```", "no fence", '<answer>\n{"sql": "SELECT 2"}\n</answer>', FORM, "```sql```", "<answer>\n{bad\n</answer>",
    ]
    assert column(spark, text.last_sql_fence(T), rows) == ["B", None, None, None, "", None]
    assert column(spark, text.extract_sql(T), rows) == ["B", "no fence", "SELECT 2", "SELECT 1", "", "{bad"]


def test_guard_and_quotes(spark):
    rows = ["select 1", "drop table x", "select created from t", "SELECT replace(a, 'b', 'c')", "x;INSERT"]
    assert column(spark, text.read_only_or_marker(T), rows) == [rows[0], text.WRITE_MARKER, rows[2], text.WRITE_MARKER, text.WRITE_MARKER]
    assert len(text.WRITE_KEYWORDS) == 33
    assert column(spark, text.double_quote_identifiers(T), ["SELECT `a b`, ` FROM `c`"]) == ['SELECT "a b", " FROM "c`']


def test_names_and_limits(spark):
    assert column(spark, text.short_model_name(T), ["org/Model-1.5.json", "m"]) == ["Model-1_5", "m"]
    assert column(spark, text.short_dataset_name(T), ["data/x/dev.json"]) == ["data_x_dev"]
    assert column(spark, text.time_limit(F.col("t")), [0.0, 10.0, 500.0], "t double") == [10.0, 22.0, 500.0]


def test_two_section_form(spark):
    rows = [
        FORM, "  " + FORM + "\n", FORM.upper(), FORM + "x", "x" + FORM, FORM.replace("</think>\n", "</think>x"), "<think></think><answer></answer>",
        FORM + FORM, "<think></answer>", "<think>a</think> <answer>b</answer>", "<think><answer></think></answer>",
    ]
    assert column(spark, formats.format_score(T, "think"), rows) == [1, 1, 1, 0, 0, 0, 1, 1, 0, 1, 0]
    assert column(spark, formats.format_penalty(T), [FORM, FORM.replace("think", "reasoning")]) == [-1, 0]


def test_full_form_and_recall(spark):
    swapped = FULL.replace("tables>", "T>").replace("columns>", "tables>").replace("T>", "columns>")
    assert column(spark, formats.full_form_score(T), [FULL, FULL + "x", FORM, swapped]) == [1, 0, 0, 0]
    tables = [(FULL, ["Garden Plots ", "seed kinds"]), (FULL, ["other"]), (FULL, []), (FORM, ["a"]), (FULL, None)]
    assert column(spark, scores.table_recall(T, F.col("truth")), tables, "text string, truth array<string>") == [1, 0, 0, 0, 0]
    columns = [(FULL, ["garden plots.bed count", "seed kinds.label", "x.y", "x.y"])]
    assert column(spark, scores.column_recall(T, F.col("truth")), columns, "text string, truth array<string>") == [pytest.approx(2 / 3)]


def test_tag_counts(spark):
    rows = [FORM, FORM + "\n</answer>", "", "<think>\n<think>\n"]
    assert column(spark, formats.tag_count_score(T), rows) == [1.0, 0.75, 0.0, 0.0]
    good = "<reasoning>a</reasoning> x <answer>b</answer>"
    rows = [good, good + "<answer>", "<answer>b</answer><reasoning>a</reasoning>", "<reasoning>", ""]
    assert column(spark, formats.ordered_tags_once(T), rows) == [True, False, False, False, False]


_pieces = st.lists(st.sampled_from(["<think>", "</think>", "<answer>", "</answer>", " ", "\n", "x"]), max_size=9).map("".join)


@settings(max_examples=20, deadline=None)
@given(st.lists(_pieces, min_size=1, max_size=40))
def test_two_section_form_against_a_plain_regex(spark, rows):
    plain = re.compile(r"\s*<think>\s*[\s\S]*?\s*</think>\s*<answer>\s*[\s\S]*?\s*</answer>\s*")
    want = [float(bool(plain.fullmatch(r.strip()))) for r in rows]
    assert column(spark, formats.format_score(T, "think"), rows) == want


def _penalty(tokens):
    """Five tokens in a row that come up again, against all runs of five; the padding mark -100 is no token."""
    shown = [str(t) for t in tokens if t != -100]
    runs = [" ".join(shown[k : k + 5]) for k in range(max(len(shown) - 4, 0))]
    repeated = sum(run in runs[:k] for k, run in enumerate(runs))
    return -1.0 if 2 * repeated > len(runs) else 0.0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 2, -100]), max_size=60), min_size=1, max_size=30))
def test_repetition_penalty(spark, rows):
    got = column(spark, scores.repetition_penalty(F.col("ids")), [(r,) for r in rows], "ids array<int>")
    assert got == [_penalty(r) for r in rows]


def test_repetition_penalty_edges(spark):
    rows = [(None,), ([],), ([1] * 4,), ([1] * 5,), ([1] * 9,), (list(range(9)),)]
    assert column(spark, scores.repetition_penalty(F.col("ids")), rows, "ids array<int>") == [0, 0, 0, 0, -1, 0]


def test_small_reward_order_of_tests(spark):
    rows = [(1.0, True, False), (0.05, True, True), (0.4, True, True), (0.4, True, False), (0.9, False, True), (1.5, True, True)]
    schema = "score double, ran boolean, gate boolean"
    plain = scores.small_reward(F.col("score"), F.col("ran"), F.col("gate"))
    assert column(spark, plain, rows, schema) == [1.0, 0.1, 0.4, 0.0, 0.0, None]
    stepped = scores.small_reward(F.col("score"), F.col("ran"), steps=True)
    rows = [(s, True, True) for s in (0.0, 0.1, 0.5, 0.79, 0.8, 1.0, -1.0, 2.0)]
    assert column(spark, stepped, rows, schema) == [0.1, 0.5, 0.8, 0.8, 0.9, 1.0, None, None]


def test_stepwise_and_run_or_match(spark):
    good = "<reasoning>\nabc\n</reasoning>\n<answer>\nSELECT 1\n</answer>"
    rows = [(good, True, 1.0), (good, True, 0.0), (good, False, 1.0), ("SELECT 1", True, 1.0)]
    schema = "text string, ran boolean, m double"
    got = column(spark, scores.stepwise_reward(T, F.col("ran"), F.col("m")), rows, schema)
    assert got == [pytest.approx(6 + 11 / 2048 * 0.5 + 1.0), 0.0, -1.0, -1.0]
    assert column(spark, scores.run_or_match_reward(T, F.col("ran"), F.col("m")), rows, schema) == [1.0, 0.1, 0.0, 1.0]


def test_identifier_set(spark):
    got = column(spark, text.identifier_set(T), [" A,`b`, \"a\",'B' ", "", string.ascii_uppercase])
    assert got == [["a", "b"], [""], [string.ascii_lowercase]]
