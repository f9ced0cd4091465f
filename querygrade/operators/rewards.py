"""Named rewards, their weighted sum, and scaling per prompt or batch.

Every reward is a function of an answer table with the columns ``text``, ``both_ran``, the
metric columns of :mod:`querygrade.operators.compare`, ``tbls_in_query``, ``cols_in_query`` and
``token_ids``; a reward touches only the ones it needs. Rewards of one answer are columns. Those that need a second
table or the other answers of a group are steps over the whole frame, taken after the columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrade.functions import formats, scores
from querygrade.operators.compare import COMBINED
from querygrade.operators.language import foreign_language_penalty
from querygrade.operators.length_penalty import penalise_length

STD_GUARD = 1e-4


def metric_reward(metric: str) -> Column:
    """The metric, 0 when either query failed."""
    return F.when(F.col("both_ran"), F.coalesce(F.col(metric), F.lit(0.0))).otherwise(0.0)


def _stepwise(metric: str) -> Column:
    return scores.stepwise_reward(F.col("text"), F.col("both_ran"), F.col(metric))


def _run_or_match(metric: str) -> Column:
    return scores.run_or_match_reward(F.col("text"), F.col("both_ran"), F.col(metric))


def _small(metric: str, gated: bool = False, steps: bool = False) -> Column:
    gate = formats.format_score(F.col("text"), "think") == 1.0 if gated else None
    return scores.small_reward(F.col(metric), F.col("both_ran"), gate, steps)


# The reward names that configurations use.
COLUMN_REWARDS: dict[str, Callable[[], Column]] = {
    "EX": partial(metric_reward, "bird_ex"),
    "EX_EX": partial(metric_reward, "ex"),
    "QATCH": partial(metric_reward, COMBINED),
    "format": lambda: formats.format_score(F.col("text"), "reasoning"),
    "format_think": lambda: formats.format_score(F.col("text"), "think"),
    "tag_count": lambda: formats.tag_count_score(F.col("text")),
    "multi_tag_format": lambda: formats.full_form_score(F.col("text")),
    "table_recall": lambda: scores.table_recall(F.col("text"), F.col("tbls_in_query")),
    "column_recall": lambda: scores.column_recall(F.col("text"), F.col("cols_in_query")),
    "SQL-R1": partial(_stepwise, "bird_ex"),
    "arctic_sql": partial(_run_or_match, "bird_ex"),
    "SQL-R1-EX": partial(_stepwise, "ex"),
    "arctic_sql_EX": partial(_run_or_match, "ex"),
    "qatch_small_update": partial(_small, COMBINED),
    "ex_small_update": partial(_small, "bird_ex"),
    "qatch_small_update_with_fm": partial(_small, COMBINED, gated=True),
    "qatch_small_update_fm_with_buckets": partial(_small, COMBINED, gated=True, steps=True),
    "ex_small_update_with_fm": partial(_small, "bird_ex", gated=True),
    "penalty_repetitions": lambda: scores.repetition_penalty(F.col("token_ids")),
    "penalty_no_format": lambda: formats.format_penalty(F.col("text"), "reasoning"),
}
GROUP_REWARDS: dict[str, str] = {"qatch_complex": COMBINED, "ex_complex": "bird_ex"}


@dataclass(frozen=True)
class LanguageProfile:
    """The second table of ``penalty_not_english``: a stored profile of :mod:`querygrade.operators.language`, and its languages."""

    words: DataFrame
    languages: list[str]


def language_reward(answers: DataFrame, key: str, profile: LanguageProfile | None, name: str) -> DataFrame:
    """Adds the language penalty, found by the answer's ``key``, which must be unique; an answer without one gets 0."""
    if profile is None:
        raise ValueError(f"{name} needs a language profile")
    verdict = foreign_language_penalty(answers.where(F.col(key).isNotNull()), key, "text", profile.words, profile.languages)
    return answers.join(verdict.withColumnRenamed("penalty", name), key, "left").fillna(0.0, [name])


TABLE_REWARDS: dict[str, Callable[..., DataFrame]] = {"penalty_not_english": language_reward}
REWARD_NAMES = (*COLUMN_REWARDS, *TABLE_REWARDS, *GROUP_REWARDS)


def complex_reward(answers: DataFrame, metric: str, group: str, generations: int, name: str, length: str = "") -> DataFrame:
    """Metric reward lowered by the length penalty of its prompt group (strength 0.1); ``length`` may name a column of lengths."""
    ready = answers.withColumn("score", metric_reward(metric)).withColumn("length", F.col(length) if length else F.length("text"))
    return penalise_length(ready, group, generations).withColumnRenamed("penalised", name).drop("score", "length", "penalty")


def named_rewards(
    answers: DataFrame,
    names: str | list[str],
    group: str = "prompt_id",
    generations: int = 16,
    key: str = "answer_id",
    profile: LanguageProfile | None = None,
) -> DataFrame:
    """Adds one column per reward name; an unknown name raises ``KeyError``.

    ``key`` names the answers and ``profile`` the second table; only rewards that need a second table use them.
    """
    wanted = names.split() if isinstance(names, str) else list(names)
    unknown = [n for n in wanted if n not in REWARD_NAMES]
    if unknown:
        raise KeyError(unknown[0])
    plain = {n: COLUMN_REWARDS[n]() for n in wanted if n in COLUMN_REWARDS}
    if any(n in GROUP_REWARDS for n in wanted):
        plain["_reward_length"] = F.length("text")  # taken before the joins, which then need not carry the texts along
    result = answers.withColumns(plain) if plain else answers
    for name in wanted:
        if name in TABLE_REWARDS:
            result = TABLE_REWARDS[name](result, key, profile, name)
        elif name in GROUP_REWARDS:
            result = complex_reward(result, GROUP_REWARDS[name], group, generations, name, "_reward_length")
    return result.drop("_reward_length")


def weighted_sum(rewards: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight times reward over the same names."""
    if set(rewards) != set(weights):
        raise ValueError("rewards and weights need the same names")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + rewards[name] * weight
    return total


def scale_rewards(answers: DataFrame, reward: str, group: str, by: str = "group") -> DataFrame:
    """Adds ``scaled``: the reward minus its group mean, over a standard deviation.

    ``by`` names the deviation used: that of the ``group``, of the whole ``batch``, or ``none``. Rows without a
    group are one group.
    """
    stats = answers.groupBy(group).agg(F.avg(reward).alias("group_mean"), F.stddev_samp(reward).alias("group_std"))
    stats = stats.withColumnRenamed(group, "stats_of")
    joined = answers.join(stats, F.col(group).eqNullSafe(F.col("stats_of"))).drop("stats_of")
    centred = joined.withColumn("scaled", F.col(reward) - F.col("group_mean"))
    if by == "group":
        spread = F.coalesce("group_std", F.lit(0.0)) + STD_GUARD
    elif by == "batch":
        spread = F.coalesce(answers.select(F.stddev_samp(reward)).scalar(), F.lit(0.0)) + STD_GUARD
    elif by == "none":
        spread = F.lit(1.0)
    else:
        raise ValueError(f"cannot scale by {by!r}")
    return centred.withColumn("scaled", F.col("scaled") / spread).drop("group_mean", "group_std")
