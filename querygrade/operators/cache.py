"""Result cache: key, lookup, and merge of cache tables that differ in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrade.functions.cells import query_key

KEY = "hash_key"


def with_key(workload: DataFrame) -> DataFrame:
    return workload.withColumn(KEY, query_key(F.col("db_id"), F.col("sql")))


def cache_hits(workload: DataFrame, cache: DataFrame) -> DataFrame:
    return workload.join(cache.select(KEY), KEY, "left_semi")


def cache_misses(workload: DataFrame, cache: DataFrame) -> DataFrame:
    return workload.join(cache.select(KEY), KEY, "left_anti")


def _first_rows(rows: DataFrame, payload: list[str], order: Column) -> DataFrame:
    """First row per key by ``order``. The minimum combines on the map side, so a hot key is not sorted."""
    kept = F.struct("source_rank", *payload)
    first = rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min_by(kept, order).alias("row"))
    # A null key clashes with nothing, as in a unique index.
    keyless = rows.where(F.col(KEY).isNull()).select(KEY, "source_rank", *payload)
    return first.select(KEY, "row.*").unionByName(keyless)


def merge_caches(sources: list[DataFrame], order: str = "row_rank", existing: DataFrame | None = None) -> DataFrame:
    """Union of caches on the destination's columns; the first row of a key wins.

    Existing rows win over all sources, then sources win in list order, then rows in the order
    of the column ``order``. The destination's columns are those of ``existing``, else of the
    first source; a source that lacks one gives null. ``source_rank`` is -1 for existing rows.
    """
    tables = ([existing.withColumn(order, F.lit(0))] if existing is not None else []) + sources
    columns = [c for c in tables[0].columns if c not in (KEY, order)]
    types = {f.name: f.dataType for f in tables[0].schema.fields}
    offset = -1 if existing is not None else 0
    ranked = []
    for i, source in enumerate(tables):
        if not set(source.columns) & {KEY, *columns}:
            continue
        has = lambda c: F.col(c) if c in source.columns else F.lit(None)
        ranked.append(
            source.select(
                has(KEY).cast("string").alias(KEY),
                F.col(order).cast("long").alias(order),
                F.lit(i + offset).alias("source_rank"),
                *[has(c).cast(types[c]).alias(c) for c in columns],
            )
        )
    rows = reduce(DataFrame.unionByName, ranked)
    return _first_rows(rows, columns, F.struct("source_rank", order))


def merge_cache_rows(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """As ``merge_caches`` for any number of files that ``sources.cache_files.read_cache_files`` reads in one scan.

    The first row of a key wins: existing rows before all files, files in order of their path, rows in order of their
    place in the file. One minimum over (path, place) decides, so a key with many rows is combined on the map side. Columns are
    those of ``existing``, else all that any file has; what a file lacks is null. ``source_path`` is null for
    existing rows. Rows without a key clash with nothing.
    """
    about = ("source_path", "row_rank")
    columns = [c for c in (existing or rows).columns if c not in (KEY, *about)]
    types = {f.name: f.dataType for f in (existing or rows).schema.fields}
    has = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c)
    merged = rows.select(F.col(KEY).cast("string").alias(KEY), *about, *[has(c) for c in columns])
    if existing is not None:
        # Existing rows have no path; their place only keeps rows without a key apart.
        place = [F.lit(None).cast("string").alias("source_path"), F.monotonically_increasing_id().alias("row_rank")]
        merged = existing.select(F.col(KEY).cast("string").alias(KEY), *place, *columns).unionByName(merged)
    kept = F.struct("source_path", *columns)
    # A row without a key is a group of its own. Nulls come first in a struct's order, so existing rows do.
    alone = [F.when(F.col(KEY).isNull(), F.col(c)).alias(f"own_{c}") for c in about]
    return merged.groupBy(KEY, *alone).agg(F.min_by(kept, F.struct(*about)).alias("row")).select(KEY, "row.*")


def inserted_per_source(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("source_rank") >= 0).groupBy("source_rank").agg(F.count(F.lit(1)).alias("inserted"))


def new_rows(sources: DataFrame, cache: DataFrame, order: str = "row_rank") -> DataFrame:
    """Rows to append: first row of each key the cache does not hold. Running it twice adds nothing."""
    payload = [c for c in sources.columns if c not in (KEY, order)]
    missing = cache_misses(sources, cache).withColumn("source_rank", F.lit(0))
    return _first_rows(missing, payload, F.struct(F.col(order))).drop("source_rank")
