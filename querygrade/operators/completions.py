"""From saved model responses to one row per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE_SCHEMA = "choices array<struct<index:int, message:struct<role:string, content:string>>>"
CHUNK_BITS = 10


def unwrap_completions(frame: DataFrame, column: str = "completion") -> DataFrame:
    """An array of messages becomes one row per sample with its text."""
    others = [c for c in frame.columns if c != column]
    return frame.select(*others, F.posexplode(column).alias("sample_idx", "message")).select(
        *others, "sample_idx", F.col("message.content").alias("text")
    )


def choices_of_responses(frame: DataFrame, column: str = "response") -> DataFrame:
    """A saved JSON response becomes one row per choice with its text."""
    others = [c for c in frame.columns if c != column]
    choices = F.from_json(column, RESPONSE_SCHEMA)["choices"]
    return frame.select(*others, F.posexplode(choices).alias("sample_idx", "choice")).select(
        *others, "sample_idx", F.col("choice.message.content").alias("text")
    )


def join_in_order(frame: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``(*keys, text)``: the texts of each group joined in order; null counts as empty."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return frame.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p.t), "").alias(text))


def assemble_deltas(deltas: DataFrame, keys: list[str], seq: str = "seq", delta: str = "delta") -> DataFrame:
    """``(*keys, text)``: streamed pieces put together in order of ``seq``.

    Runs of ``2^CHUNK_BITS`` sequence numbers are joined first, so the pieces of one long
    stream are sorted by many tasks and only whole runs meet at the end.
    """
    chunked = deltas.withColumn("chunk", F.shiftright(seq, CHUNK_BITS))
    runs = join_in_order(chunked, [*keys, "chunk"], seq, delta)
    return join_in_order(runs, keys, "chunk", delta).withColumnRenamed(delta, "text")
