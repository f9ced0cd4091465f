"""Secret scans: known forms by pattern, other strings by the entropy of sliding windows.

A candidate string is a run of characters that keys are written in. A window slides over it; counts of the
characters in the window, and the sum of count * log2(count), are carried from one place to the next, so each
step costs the same. The string is a secret if some window's entropy reaches the limit of its character class and
no entry of the allow list covers it; a word of examples covers the part between / and = that it is in.
Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

#: Patterns of the base kinds and the least length of what they must hold, as the contract of the query states them.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = r"[0-9a-f]{16,}"

#: Characters of a candidate, its least length, and the window.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class of a candidate (pattern of the whole string) and the bits a window must reach; the first that fits counts.
CLASSES = [
    (r"[0-9]+", 99.0),
    (r"[0-9a-fA-F]+", 3.0),
    (r"[A-Za-z]+", 4.1),
    (r"[A-Za-z0-9+/_=-]+", 3.75),
]
#: Candidates that are no secrets: words joined by marks, paths of words, number groups, repeated rulers.
ALLOWED = [
    r"[A-Za-z]?[a-z]+([-_/=+]+[A-Za-z]?[a-z]+)*[-_/=+]*",
    r"[-_/=+0-9]+",
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
]


#: Words of examples: the parts of a candidate, which end at / or =, that hold one are left out; what lies between is judged.
EXAMPLES = r"(?i)example|placeholder|changeme|xxxx|lorem|test"
PART_END = r"(?<=[/=])"


_SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def _bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, also where ``use`` holds it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of the leftmost matches that do not overlap: what lies between them tells where they are."""
    place = KINDS.index(kind)
    empty = F.array().cast(_SPANS)

    def walk(both: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.element_at(both["between"], i))
            match = F.element_at(both["found"], i)
            span = F.struct(start.alias("start"), F.lit(place).alias("kind"), (start + F.length(match)).alias("end"), match.alias("match"))
            return F.struct((start + F.length(match)).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return F.aggregate(F.sequence(F.lit(1), F.size(both["found"])), state, step, lambda s: s["spans"])

    def located(found: Column) -> Column:
        both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between"))
        return F.when(F.size(found) > 0, _bound(both, walk)).otherwise(empty)

    spans = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return spans if keep is None else F.filter(spans, lambda s: keep(s["match"]))


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any window of the string; -1 if it is shorter than a window."""
    weights = F.array(*[F.lit(k * math.log2(k) if k > 1 else 0.0) for k in range(window + 2)])
    weight = lambda n: F.element_at(weights, n + 1)

    def slide(codes: Column) -> Column:
        def leave(state: Column, i: Column) -> Column:
            """Take the character that the window leaves behind out of the counts; code 0 stands for none."""
            going = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))

            def without(code: Column) -> Column:
                had = F.when(code > 0, F.element_at(state["counts"], F.greatest(code, F.lit(1)))).otherwise(F.lit(1))
                counts = F.when(code > 0, F.transform(state["counts"], lambda v, k: F.when(k + 1 == code, v - 1).otherwise(v))).otherwise(state["counts"])
                return F.struct(counts.alias("counts"), (state["total"] - weight(had) + weight(had - 1)).alias("total"), state["best"].alias("best"))

            return _bound(going, without)

        def enter(state: Column, i: Column) -> Column:
            def having(both: Column) -> Column:
                code, left = both["code"], both["left"]
                had = F.element_at(left["counts"], code)
                total = left["total"] - weight(had) + weight(had + 1)
                bits = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(-1.0))
                counts = F.transform(left["counts"], lambda v, k: F.when(k + 1 == code, v + 1).otherwise(v))
                return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(left["best"], bits).alias("best"))

            return _bound(F.struct(F.element_at(codes, i).alias("code"), leave(state, i).alias("left")), having)

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, enter, lambda s: s["best"])

    return _bound(F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c)), slide)


def _is_secret(string: Column) -> Column:
    limit = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        limit = F.when(string.rlike(f"^(?:{pattern})$"), F.lit(bits)).otherwise(limit)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | string.rlike(f"^(?:{pattern})$")
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(string) >= limit)


def _holds_secret(candidate: Column) -> Column:
    """Whether the candidate, or if it has words of examples one of the runs of parts without them, is a secret."""
    parts = F.transform(F.split(candidate, PART_END), lambda p: F.when(p.rlike(EXAMPLES), F.lit(" ")).otherwise(p))
    runs = F.filter(F.split(F.array_join(parts, ""), " "), lambda r: F.length(r) >= WINDOW)
    return F.when(candidate.rlike(EXAMPLES), F.exists(runs, _is_secret)).otherwise(_is_secret(candidate))


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``spans`` to every row of ``docs``: array of (start, kind, end, match) in order of start, then kind.

    Places are code points, the end exclusive; kind is a place in KINDS. Base spans stay as they are; entropy spans
    that lie within a base span are left out. Null texts count as empty and have no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    group = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    base = docs.withColumn("_base", F.concat(_spans(text, ASSIGN, "assign", group), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    other = _spans(text, CANDIDATE, "entropy", _holds_secret)
    added = F.filter(other, lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return base.withColumn("spans", F.array_sort(F.concat("_base", added))).drop("_base")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; columns besides doc_id and text are ignored."""
    rows = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("entropy"))
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", numbers: bool = False) -> DataFrame:
    """Every row with the parts of ``text`` that lie in a span replaced by the mark; null texts stay null.

    Spans that hold digits only, which the hex pattern finds too, are replaced if ``numbers`` is set, as in the pipeline.
    """
    rows = with_spans(docs)
    text = F.col("text")
    real = F.col("spans") if numbers else F.filter("spans", lambda s: ~s["match"].rlike("^[0-9]+$"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(real, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.size(real) > 0, done).otherwise(text)).drop("spans")
