"""All registered queries by name: ``(run, sql)``; ``sql`` is None where SQL cannot say it."""

from __future__ import annotations

from querygrade.suite import (
    answer_suite,
    compare_suite,
    curate_suite,
    evaluate_suite,
    lineage_suite,
    source_suite,
    stream_suite,
    workload_suite,
)

REGISTERED = {
    **compare_suite.QUERIES,
    **answer_suite.QUERIES,
    **curate_suite.QUERIES,
    **evaluate_suite.QUERIES,
    **lineage_suite.QUERIES,
    **workload_suite.QUERIES,
    **source_suite.QUERIES,
    **stream_suite.QUERIES,
}
