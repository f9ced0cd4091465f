"""Structured Streaming jobs.

All sinks write Parquet by batch number and replace a batch that is run again, so a restart
from the checkpoint neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querygrade.operators.cache import KEY, new_rows
from querygrade.operators.completions import CHUNK_BITS, join_in_order


def start(stream: DataFrame, mode: str, folder: str, write: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    """Start a query that bears the name of its folder."""
    writer = stream.writeStream.queryName(folder).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replace_batch(folder: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")


def score_stream(
    answers: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, once: bool = True
) -> StreamingQuery:
    """Score answers as they arrive, each row on its own. ``score`` gets each batch as a plain DataFrame."""
    write = replace_batch(folder)
    return start(answers, "append", folder, lambda batch, number: write(score(batch), number), once)


def assemble_stream(deltas: DataFrame, keys: list[str], folder: str, once: bool = True) -> StreamingQuery:
    """Put streamed pieces together per run of sequence numbers; ``read_assembled`` joins the runs.

    State holds one entry per run. Each batch writes the runs it changed; the latest counts.
    """
    chunked = deltas.withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    runs = join_in_order(chunked, [*keys, "chunk"], "seq", "delta")
    return start(runs, "update", folder, replace_batch(folder), once)


def assemble_stream_until(
    deltas: DataFrame, keys: list[str], arrival: str, lateness: str, gap: str, folder: str, once: bool = True
) -> StreamingQuery:
    """As ``assemble_stream`` for endless streams: a run closes once it has had no piece for ``gap``.

    Runs are sessions of event time. When the watermark passes the end of one it is written and leaves the state,
    so state holds open runs only. A run that goes on after a longer gap is put together from all its sessions;
    ``late_pieces`` counts the pieces that came after the end of theirs. A row without a sequence number is a sign
    of life: it moves the watermark and nothing else, so the last runs close too. Null arrivals are left out.
    """
    # The arrival is named in the filter, or Spark would move it below the watermark and signs of life were not seen.
    alive = deltas.withWatermark(arrival, lateness).where(F.col("seq").isNotNull() | F.col(arrival).isNull())
    chunked = alive.withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("t"))))
    runs = chunked.groupBy(*keys, "chunk", F.session_window(arrival, gap).alias("session")).agg(pieces.alias("pieces"))
    return start(runs, "append", folder, replace_batch(folder), once)


def open_runs(query: StreamingQuery) -> int:
    """Runs that are still in the state of a query."""
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else 0


def late_pieces(query: StreamingQuery) -> int:
    """Pieces that a query of ``assemble_stream_until`` has ignored because their session was already written."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def read_assembled(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """``(*keys, text)`` from the latest state of every run, or from all its sessions in order of sequence."""
    runs = spark.read.parquet(f"{folder}/rows")
    if "pieces" in runs.columns:
        # A run has at most 2^CHUNK_BITS pieces, whatever the number of sessions.
        latest = runs.groupBy(*keys, "chunk", "session").agg(F.max_by("pieces", "batch").alias("pieces"))
        ordered = F.sort_array(F.flatten(F.collect_list("pieces")))
        joined = latest.groupBy(*keys, "chunk").agg(F.array_join(F.transform(ordered, lambda p: p.t), "").alias("delta"))
        return join_in_order(joined, keys, "chunk", "delta").withColumnRenamed("delta", "text")
    latest = runs.groupBy(*keys, "chunk").agg(F.max_by("delta", "batch").alias("delta"))
    return join_in_order(latest, keys, "chunk", "delta").withColumnRenamed("delta", "text")


def cache_part(bits: int) -> Column:
    """Which of 2^bits equal ranges of the key's hash a row lies in."""
    return F.shiftrightunsigned(F.xxhash64(KEY), 64 - bits).cast("int")


def known_keys(spark: SparkSession, folder: str, batch: int, parts: list[int]) -> DataFrame:
    """Keys that batches before this one have put into some parts of the cache; files of other parts are not read."""
    rows = spark.read.schema(f"{KEY} string, batch int, part int").parquet(f"{folder}/rows")
    return rows.where(F.col("part").isin(parts) & (F.col("batch") < batch)).select(KEY)


def append_to_cache_stream(
    rows: DataFrame, folder: str, arrival: str | None = None, lateness: str = "1 hour", once: bool = True, bits: int = 6
) -> StreamingQuery:
    """Append new keys of a stream to the cache table ``folder/rows``; known keys are ignored.

    The table is laid out by 2^bits ranges of the key's hash. A batch reads the ranges that its own keys lie in, and
    writes one file for each. The watermark drops repeats cheaply before the cache is looked at; the anti-join keeps
    the cache free of doubles over any distance. A batch that runs again does not see its own rows.
    """
    if arrival is not None:
        rows = rows.withWatermark(arrival, lateness).dropDuplicatesWithinWatermark([KEY])

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        try:
            known = session.createDataFrame([], f"{KEY} string")
            if number > 0:
                parts = [r["part"] for r in batch.select(cache_part(bits).alias("part")).distinct().collect()]  # 2^bits at most
                known = known_keys(session, folder, number, parts)
            fresh = new_rows(batch, known).withColumn("part", cache_part(bits))
            # Rows without a key, which never clash, are all of one part but of many tasks.
            keyless = F.when(F.col(KEY).isNull(), F.pmod(F.xxhash64(*fresh.columns), F.lit(1 << bits)))
            fresh.repartition("part", keyless).write.mode("overwrite").partitionBy("part").parquet(
                f"{folder}/rows/batch={number}"
            )
        finally:
            batch.unpersist()

    return start(rows, "append", folder, write, once)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``append_to_cache_stream`` has kept."""
    return spark.read.parquet(f"{folder}/rows").drop("batch", "part")
