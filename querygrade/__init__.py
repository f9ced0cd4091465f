"""querygrade: curate, run, compare and grade SQL workloads with Spark."""
