"""Format scores: does an answer keep to the agreed tags?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querygrade.functions.text import WHITESPACE_CLASS, strip

# Tags of the full form, and the line-bound marks worth a quarter each.
FULL_FORM = ("reasoning", "tables", "columns", "checks", "answer")
QUARTER_MARKS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")


def _only_sections(text: Column, tags: tuple[str, ...]) -> Column:
    """Is the text these sections in this order, with only white space between them?

    Each ``</a> <b>`` seam is an atomic group, so the leftmost seam is taken and never given
    back. The leftmost one leaves the most room for the rest, so nothing is lost, and the
    match is linear on long or hostile texts.
    """
    seams = "".join(f"(?>.*?</{a}>{WHITESPACE_CLASS}*<{b}>)" for a, b in zip(tags, tags[1:]))
    return strip(text).rlike(f"(?isu)\\A<{tags[0]}>{seams}.*</{tags[-1]}>\\z")


def format_score(text: Column, reasoning_tag: str = "reasoning") -> Column:
    """1.0 when the text is a reasoning section and an answer section, else 0.0."""
    return _only_sections(text, (reasoning_tag, "answer")).cast("double")


def format_penalty(text: Column, reasoning_tag: str = "reasoning") -> Column:
    return format_score(text, reasoning_tag) - 1.0


def full_form_score(text: Column) -> Column:
    """1.0 when all five sections stand in order and nothing else does, else 0.0."""
    return _only_sections(text, FULL_FORM).cast("double")


def occurs_once(text: Column, literal: str) -> Column:
    """Exactly one non-overlapping occurrence."""
    rest = F.replace(text, F.lit(literal), F.lit(""))
    return F.length(text) - F.length(rest) == len(literal)


def tag_count_score(text: Column) -> Column:
    """A quarter for each line-bound mark that occurs exactly once."""
    total = F.lit(0.0)
    for mark in QUARTER_MARKS:
        total = total + F.when(occurs_once(text, mark), 0.25).otherwise(0.0)
    return total


def ordered_tags_once(text: Column, think_tag: str = "reasoning", answer_tag: str = "answer") -> Column:
    """All four tags exactly once, and in order."""
    tags = [f"<{think_tag}>", f"</{think_tag}>", f"<{answer_tag}>", f"</{answer_tag}>"]
    verdict = F.lit(True)
    for tag in tags:
        verdict = verdict & occurs_once(text, tag)
    for first, second in zip(tags, tags[1:]):
        verdict = verdict & (F.instr(text, first) <= F.instr(text, second))
    return verdict
