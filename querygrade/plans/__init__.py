"""Whole jobs: running a workload, reading lineage from plans, evaluating predictions."""
