"""Recall scores, the repetition penalty and the composite reward formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querygrade.functions.formats import ordered_tags_once
from querygrade.functions.text import extract_sql, identifier_set, strip, tag_body

# Fixed values of the published reward schemes.
STEP_FORMAT, STEP_RUN, STEP_RESULT = 1.0, 2.0, 3.0
LENGTH_LIMIT, LENGTH_WEIGHT = 2048, 0.5
SMALL_REWARD = 0.1
SCORE_STEPS = ((0.1, 0.1), (0.5, 0.5), (0.8, 0.8), (1.0, 0.9))  # (score below, reward)
TOKEN_PADDING = -100


def list_recall(text: Column, tag: str, truth: Column, quotes: str) -> Column:
    """Share of the true names that the tagged list holds; 0 without a list or a truth."""
    said = identifier_set(tag_body(text, tag), quotes)
    true = F.array_distinct(F.transform(truth, lambda name: F.lower(strip(name))))
    share = F.try_divide(F.size(F.array_intersect(said, true)).cast("double"), F.size(true))
    return F.when(said.isNotNull(), F.coalesce(share, F.lit(0.0))).otherwise(0.0)


def table_recall(text: Column, truth: Column) -> Column:
    return list_recall(text, "tables", truth, "`\"'")


def column_recall(text: Column, truth: Column) -> Column:
    return list_recall(text, "columns", truth, "`")


def repetition_penalty(tokens: Column, n: int = 5, threshold: float = 0.5) -> Column:
    """-1 when fewer than ``threshold`` of the n-grams are distinct, else 0.

    N-grams are ``n`` shifted slices zipped together, so each token array is walked a fixed
    number of times. They are compared by a 64-bit hash: ``array_distinct`` on bigint uses a
    primitive hash set, on nested arrays it compares all pairs.
    """

    def verdict(kept: Column) -> Column:
        count = F.greatest(F.size(kept) - (n - 1), F.lit(0))
        shifted = [F.slice(kept, i + 1, count) for i in range(n)]
        grams = F.transform(F.arrays_zip(*shifted), lambda gram: F.xxhash64(gram))
        ratio = F.try_divide(F.size(F.array_distinct(grams)).cast("double"), count)
        return F.when(ratio < threshold, -1.0).otherwise(0.0)

    # Bound to a name: lambdas are interpreted, and what they are applied to would be computed at every mention.
    kept = F.filter(tokens, lambda t: t.isNull() | (t.cast("string") != str(TOKEN_PADDING)))
    return F.coalesce(F.transform(F.array(kept), verdict)[0], F.lit(0.0))


def stepwise_reward(text: Column, both_ran: Column, match: Column) -> Column:
    """Format, run and result points, plus a length bonus for a right result."""
    reasoning, body = tag_body(text, "reasoning"), tag_body(text, "answer")
    think = F.when(F.length(reasoning) > 0, reasoning).otherwise(text)
    answer = F.when(F.length(body) > 0, body).otherwise(text)
    written = F.least(F.length(think) + F.length(answer), F.lit(LENGTH_LIMIT))
    bonus = written / LENGTH_LIMIT * LENGTH_WEIGHT + F.try_divide(F.length(extract_sql(text)), F.length(answer))
    return (
        F.when(~ordered_tags_once(text), -STEP_FORMAT)
        .when(~both_ran, STEP_FORMAT - STEP_RUN)
        .when(match > 0, STEP_FORMAT + STEP_RUN + STEP_RESULT + bonus)
        .otherwise(STEP_FORMAT + STEP_RUN - STEP_RESULT)
    )


def run_or_match_reward(text: Column, both_ran: Column, match: Column) -> Column:
    """1 for a match, a small reward for a well-formed answer that ran, else 0."""
    formed = tag_body(text, "reasoning").isNotNull() & tag_body(text, "answer").isNotNull()
    return F.when(~both_ran, 0.0).when(match > 0, 1.0).when(formed, SMALL_REWARD).otherwise(0.0)


def small_reward(score: Column, both_ran: Column, gate: Column | None = None, steps: bool = False) -> Column:
    """The score, but never under the small reward once both queries ran.

    A perfect score passes a closed gate. Scores outside [0, 1] give null.
    """
    if steps:
        graded = F.when(score < 0, None)
        for below, reward in SCORE_STEPS:
            graded = graded.when(score < below, reward)
    else:
        graded = F.when((score < 0) | (score > 1), None).otherwise(F.greatest(score, F.lit(SMALL_REWARD)))
    value = F.when(~both_ran, 0.0).when(score == 1, 1.0)
    if gate is not None:
        value = value.when(~gate, 0.0)
    return value.otherwise(graded)
