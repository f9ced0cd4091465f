"""String and JSON columns that take a model answer or a SQL text apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What `str.strip` removes, and the same set as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"

# Words that mark a statement as not read-only, and the marker that replaces it.
WRITE_KEYWORDS = (
    "INSERT UPDATE DELETE CREATE DROP ALTER TRUNCATE REPLACE GRANT REVOKE COMMIT ROLLBACK "
    "SAVEPOINT LOCK UNLOCK MERGE CALL EXECUTE EXPLAIN ANALYZE SET RENAME USE LOAD IMPORT "
    "EXPORT ATTACH DETACH VACUUM COMMENT SHUTDOWN PURGE OPTIMIZE"
).split()
WRITE_MARKER = "CRUD_OPERATION_DETECTED"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def tag_body(text: Column, tag: str) -> Column:
    """Stripped text between the first ``<tag>\\n`` and the next ``\\n</tag>``, else null.

    Two literal splits instead of a lazy regex: linear in the text whatever it holds, and an
    empty body stays apart from a missing one.
    """
    after = F.try_element_at(F.split(text, re.escape(f"<{tag}>\n"), 2), F.lit(2))
    parts = F.split(after, re.escape(f"\n</{tag}>"), 2)
    return F.when(F.size(parts) == 2, strip(parts[0]))


def last_sql_fence(text: Column) -> Column:
    """Stripped content of the last ```` ```sql ```` block, else null."""
    blocks = F.regexp_extract_all(text, F.lit("(?s)```sql(.*?)```"), F.lit(1))
    return strip(F.try_element_at(blocks, F.lit(-1)))


def extract_sql(text: Column) -> Column:
    """The SQL in an answer: last fence, else JSON ``sql`` field, else answer body, else all."""
    answer = tag_body(text, "answer")
    return F.coalesce(last_sql_fence(text), F.get_json_object(answer, "$.sql"), answer, text)


def remove_sql_blocks(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)```sql.*?```", "")


def double_quote_identifiers(sql: Column) -> Column:
    """Back-quoted identifiers as ANSI double-quoted ones."""
    return F.regexp_replace(sql, "`([^`]+)`", '"$1"')


def read_only_or_marker(sql: Column) -> Column:
    """The query itself, or a marker when any write keyword occurs as a whole word."""
    found = F.upper(sql).rlike(r"\b(" + "|".join(WRITE_KEYWORDS) + r")\b")
    return F.when(found, F.lit(WRITE_MARKER)).otherwise(sql)


def identifier_set(listing: Column, quotes: str = "`\"'") -> Column:
    """Distinct lower-case names of a comma-separated list, without quote characters."""
    bare = lambda item: F.translate(F.lower(strip(item)), quotes, "")
    return F.array_distinct(F.transform(F.split(listing, ","), bare))


def short_model_name(name: Column) -> Column:
    """Last path part, without ``.json``, dots as underscores."""
    return F.translate(F.replace(F.substring_index(name, "/", -1), F.lit(".json"), F.lit("")), ".", "_")


def short_dataset_name(name: Column) -> Column:
    return F.translate(F.replace(name, F.lit(".json"), F.lit("")), "/", "_")


def time_limit(seconds: Column, slack: float = 0.2, grace: float = 10.0, ceiling: float = 500.0) -> Column:
    """Allowed run time of a query whose gold run took ``seconds``."""
    return F.least(seconds + seconds * slack + grace, F.lit(ceiling))
