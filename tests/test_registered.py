"""Registered queries next to their SQL. QUERYGRADE_ALL=1 runs all of them, else a few quick ones."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import connect, rows_of
from querygrade.suite.registry import REGISTERED

SMALL = "/root/testdata/sf0.001"
QUICK = ["bird_ex", "sql_extract", "format_multi_tag", "penalty_repetition", "reward_sql_r1", "mix_weighted", "split_train_test", "cache_merge", "lineage_columns", "wl_cte_window_union", "stream_cache"]

needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not there")


def test_every_query_has_sql():
    assert set(REGISTERED) <= set(oracle_sql()) and len(REGISTERED) >= 88 and set(REGISTERED) <= set(queries())


@needs_data
def test_entry(spark):
    frame = entry(spark)
    assert frame.count() == 6 and {"kind", "pairs", "bird_ex"} <= set(frame.columns)


@needs_data
@pytest.mark.parametrize("name", list(oracle_sql()) if os.environ.get("QUERYGRADE_ALL") else QUICK)
def test_same_rows_as_sql(spark, name):
    frame = queries()[name](spark, SMALL)
    cursor = connect(SMALL).execute(oracle_sql()[name])
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())
