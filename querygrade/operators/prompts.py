"""Prompt rendering: a template text becomes one string column."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrade.functions.text import WHITESPACE

_SLOT = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def read_template(name: str, folder: str) -> str:
    with open(os.path.join(folder, name), encoding="utf-8") as file:
        return file.read()


def template_variables(template: str) -> list[str]:
    return list(dict.fromkeys(_SLOT.findall(template)))


def render(template: str) -> Column:
    """The template with each ``{{ name }}`` replaced by that column, ending in one newline.

    A null prints as ``None``. A slot without a column fails in analysis.
    """
    pieces = _SLOT.split(template)
    columns = [
        F.coalesce(F.col(piece).cast("string"), F.lit("None")) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
    ]
    return F.concat(F.rtrim(F.concat(*columns), F.lit(WHITESPACE)), F.lit("\n"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(
    questions: DataFrame,
    user_template: str,
    system_template: str | None = None,
    answer_column: str | None = None,
) -> DataFrame:
    """Adds ``prompt``, an array of messages, and ``completion`` when an answer column is named.

    Without an ``evidence`` column, evidence is empty. No system template, no system message.
    """
    if "evidence" not in questions.columns:
        questions = questions.withColumn("evidence", F.lit(""))
    messages = [_message("user", render(user_template))]
    if system_template:
        messages.insert(0, _message("system", render(system_template)))
    result = questions.withColumn("prompt", F.array(*messages))
    if answer_column:
        result = result.withColumn("completion", F.array(_message("assistant", F.col(answer_column))))
    return result
