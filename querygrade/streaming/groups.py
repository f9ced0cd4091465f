"""Whole groups on a stream, such as all answers of a prompt: they are scored when the last member has arrived.

Open groups wait in the state store of the query, each with at most ``members`` - 1 answers. An entry of the state
holds the open groups of one range of the group's hash: Python is called once for a range, not once for a group.
A group leaves the state when it is whole, or when it has had no answer for some time. Closed groups come out
whole within one batch, so any batch operator over groups can score them.

Answers travel through the state as JSON made and read by Spark, so no type is changed on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, FloatType, StructType

from querygrade.streaming.jobs import replace_batch, start

_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _closing(members: int, patience: int | None, by_arrival: bool) -> Callable:
    """Holds the answers of each group of a range until there are enough; then those and all others of the batch come out."""
    wait = 0 if patience is None else patience * 1000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, due = {}, {}  # answers of each open group, and when it has been silent too long
        if state.exists:
            names, answers, times = state.get
            held, due = {n: list(a) for n, a in zip(names, answers)}, dict(zip(names, times))
        now = state.getCurrentWatermarkMs() if by_arrival else state.getCurrentProcessingTimeMs()
        met, whole = set(), set()
        for frame in () if state.hasTimedOut else frames:
            names = frame["name"].tolist()
            arrived = frame["arrived_ms"].tolist() if by_arrival else [now] * len(names)
            for name, answer, at in zip(names, frame["answer"].tolist(), arrived):
                held.setdefault(name, []).append(answer)
                due[name] = max(due.get(name, now + 1), now + 1, at + wait)
            met.update(names)
            whole.update(n for n in set(names) if len(held[n]) >= members)
            out = [a for n in whole for a in held.pop(n, ())]
            if out:
                yield pd.DataFrame({"answer": out, "complete": True})
        if patience is not None:
            # Those that an answer has reached in this batch go on.
            late = [n for n in held if n not in met and due[n] < now]
            out = [a for n in late for a in held.pop(n)]
            if out:
                yield pd.DataFrame({"answer": out, "complete": False})
        if not held:
            if state.exists:
                state.remove()
            return
        times = [due[n] for n in held]
        state.update((list(held), list(held.values()), times))
        if by_arrival:
            state.setTimeoutTimestamp(min(times))
        elif patience is not None:
            state.setTimeoutDuration(max(min(times) - now, 1))

    return run


def closed_groups(
    answers: DataFrame, group: str, members: int, patience: int | None = None, arrival: str | None = None, bits: int = 12
) -> DataFrame:
    """Answers of groups that are whole (``complete``) or have had no answer for ``patience`` seconds (not ``complete``).

    With ``arrival``, a column of event times with a watermark, time is that of the data, else of the clock; without
    ``patience`` groups wait for their last member. A group closes in the batch that brings its ``members``-th answer and takes all its answers of that batch; later
    ones begin it anew. Answers without a group are one group. The state lies in 2^bits ranges of the group's hash,
    the same over all runs of a query; a batch rewrites the ranges that its groups lie in.
    """
    if arrival and patience is None:
        raise ValueError("event times need a patience")
    by_clock = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    mode = GroupStateTimeout.EventTimeTimeout if arrival else by_clock
    of = F.col(group)
    if isinstance(answers.select(of).schema[0].dataType, (FloatType, DoubleType)):
        of = of + F.lit(0.0).cast("float")  # -0.0 is 0.0, as when Spark groups
    kept = [
        F.shiftrightunsigned(F.xxhash64(of), 64 - bits).cast("int").alias("range") if bits else F.lit(0).alias("range"),
        F.to_json(F.struct(of.alias("of")), _JSON).alias("name"),
        F.to_json(F.struct(*[f"`{c}`" for c in answers.columns]), _JSON).alias("answer"),
    ]
    if arrival:
        kept += [F.coalesce(F.unix_millis(F.col(arrival)), F.lit(0)).alias("arrived_ms"), F.col(arrival).alias("arrival_time")]
    closing = _closing(members, patience, arrival is not None)
    found = answers.select(*kept).groupBy("range").applyInPandasWithState(
        closing, "answer string, complete boolean", "names array<string>, answers array<array<string>>, due array<long>", "append", mode
    )
    return found.select(_parsed(answers.schema), "complete").select("row.*", "complete")


def _parsed(schema: StructType):
    return F.from_json("answer", schema, _JSON).alias("row")


def score_groups_stream(
    answers: DataFrame,
    group: str,
    members: int,
    score: Callable[[DataFrame], DataFrame],
    folder: str,
    patience: int | None = None,
    arrival: str | None = None,
    once: bool = True,
    bits: int = 12,
) -> StreamingQuery:
    """Score groups as ``closed_groups`` gives them; ``score`` gets the closed groups of a batch as a plain DataFrame.

    ``read_open`` gives the answers that still wait, ``open_group_counts`` how many groups did after each batch.
    """
    if once and patience is not None and arrival is None:
        raise ValueError("a query that ends with its input never sees the clock run out; give an arrival column")
    write_rows = replace_batch(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # a score may read the batch several times; the state is to be updated once
        try:
            write_rows(score(batch), number)
        finally:
            batch.unpersist()

    return start(closed_groups(answers, group, members, patience, arrival, bits), "append", folder, write, once)


def read_open(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Answers that wait in the state of a stopped query of ``score_groups_stream``; ``schema`` is that of its input."""
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    return state.select(F.explode(F.flatten("value.groupState.answers")).alias("answer")).select(_parsed(schema)).select("row.*")


def open_group_counts(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, groups in state, bytes of state) after each recent batch of a query of ``score_groups_stream``."""
    spark, checkpoint = SparkSession.active(), f"{query.name}/checkpoint"
    written = spark.read.format("state-metadata").load(checkpoint).agg(F.min("minBatchId"), F.max("maxBatchId")).first()
    sizes = {p["batchId"]: sum(s["memoryUsedBytes"] for s in p["stateOperators"]) for p in query.recentProgress}
    counts = []
    for batch in sorted(b for b in sizes if written[0] <= b <= written[1]):
        state = spark.read.format("statestore").option("batchId", batch).load(checkpoint)
        held = state.agg(F.coalesce(F.sum(F.size("value.groupState.names")), F.lit(0))).first()[0]
        counts.append((batch, held, sizes[batch]))
    return counts
