"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature after the other, on a bounded sample of labelled rows. A tree
of one feature adds to that feature's table of bin values, a tree of two to the pair's table, so a score is the
sum of one looked-up value for each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import frugal, mix64, random64, stored, text_slices, utf8_of

#: Labelled rows the model is fitted on, at most in expectation; chosen by a hash of doc_id.
FIT_ROWS = 40_000
#: Bins of a feature and of each side of a pair; cycles of boosting; pairs; shrinkage; leaf penalty.
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES = 60, 30
PAIRS = 8
RATE = 0.15
PENALTY = 2.0
#: A document is kept from this score on.
KEEP = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "letters", "upper", "digits", "wide", "marks",
    "symbols", "bars", "symbol_words", "ends", "lines", "line_words", "repeated_lines", "repeated_words", "repeated_pairs", "runs", "digit_words", "capital_words",
]


def _kinds(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SPACE = _kinds(" \t\n\v\f\r")
_LETTER = _kinds("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UPPER = _kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _kinds("0123456789")
_MARK = _kinds(".,;:!?'\"()-")
_BAR = _kinds("|")
_SYMBOL = _kinds("#$%&*+/<=>@[\\]^_`{|}~")
_WIDE = np.arange(256) >= 128
_HASH = random64(256, 21)



def _repeats(names: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text the share of its parts that came before in it."""
    total = np.bincount(owner, minlength=n)
    keys = np.unique(mix64(names ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    return 1 - np.bincount(owner[keys], minlength=n) / np.maximum(total, 1)


def text_features(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros only."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros((n, len(FEATURES)))
    if not len(body):
        return out
    count = lambda kind: np.bincount(owner, weights=kind[body], minlength=n)
    inked = np.maximum(size - count(_SPACE), 1)
    column = {"log_bytes": np.log1p(size)}
    for name, kind in (("letters", _LETTER), ("upper", _UPPER), ("digits", _DIGIT), ("wide", _WIDE), ("marks", _MARK), ("symbols", _SYMBOL), ("bars", _BAR)):
        column[name] = count(kind) / inked
    same = np.zeros(len(body), bool)
    same[1:] = (body[1:] == body[:-1]) & (owner[1:] == owner[:-1])
    column["runs"] = np.bincount(owner, weights=same & ~_SPACE[body], minlength=n) / inked
    inside = ~_SPACE[body]
    fresh = np.ones(len(body), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    first = inside & (fresh | np.concatenate(([True], ~inside[:-1])))
    starts = np.flatnonzero(first)
    power = random64(64, 22)
    if len(starts):
        whose = owner[starts]
        words = np.maximum(np.bincount(whose, minlength=n), 1)
        number = np.cumsum(first) - 1
        place = np.arange(len(body)) - starts[np.maximum(number, 0)]
        ink = np.flatnonzero(inside)
        lengths = np.bincount(number[ink], minlength=len(starts))
        parts = np.zeros(len(body), np.uint64)
        parts[ink] = _HASH[body[ink]] * power[place[ink] % 64]
        names = mix64(np.add.reduceat(parts, starts))
        share = lambda flags: np.bincount(whose, weights=flags, minlength=n) / words
        has = lambda kind: np.add.reduceat((kind[body] & inside).astype(np.int32), starts) > 0
        last = starts + lengths - 1
        column |= {
            "log_words": np.log1p(np.bincount(whose, minlength=n)), "word_length": share(lengths), "long_words": share(lengths > 14), "short_words": share(lengths < 4),
            "symbol_words": share(has(_SYMBOL)), "digit_words": share(has(_DIGIT)), "ends": share(_MARK[body[last]]), "capital_words": share(_UPPER[body[starts]]),
            "repeated_words": _repeats(names, whose, n),
        }
        both = np.flatnonzero(whose[1:] == whose[:-1])
        column["repeated_pairs"] = _repeats(mix64(names[both] + names[both + 1] * np.uint64(3)), whose[both], n)
        line_end = (body == 10) | fresh
        heads = np.flatnonzero(line_end)
        line_names = mix64(np.add.reduceat(parts, heads))
        column["lines"] = np.log1p(np.bincount(owner[heads], minlength=n))
        column["line_words"] = np.log1p(words / np.maximum(np.bincount(owner[heads], minlength=n), 1))
        column["repeated_lines"] = _repeats(line_names, owner[heads], n)
    for k, name in enumerate(FEATURES):
        if name in column:
            out[:, k] = column[name]
    out[size == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """intercept + sum of tables[f][bin of f] + sum of pair_tables[p][bins of p]; ``edges`` cut the features into bins."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    intercept: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray = field(default_factory=lambda: np.zeros((0, PAIR_BINS, PAIR_BINS)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for f, cuts in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(cuts, rows[:, f], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            total += values[np.searchsorted(self.pair_edges[i], rows[:, i], side="right"), np.searchsorted(self.pair_edges[j], rows[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree with three leaves over ordered bins, from the bins' gradient and curvature sums."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    i, j = np.triu_indices(len(g), 1)
    gains = _gain(cg[i], ch[i]) + _gain(cg[j] - cg[i], ch[j] - ch[i]) + _gain(cg[-1] - cg[j], ch[-1] - ch[j])
    k = int(gains.argmax())
    out = np.empty(len(g))
    for a, b in ((0, i[k]), (i[k], j[k]), (j[k], len(g))):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + PENALTY)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree with one cut on each side of a pair, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n = len(g)
    a, b = np.arange(1, n)[:, None], np.arange(1, n)[None, :]
    gs = [cg[a, b], cg[a, n] - cg[a, b], cg[n, b] - cg[a, b], cg[n, n] - cg[a, n] - cg[n, b] + cg[a, b]]
    hs = [ch[a, b], ch[a, n] - ch[a, b], ch[n, b] - ch[a, b], ch[n, n] - ch[a, n] - ch[n, b] + ch[a, b]]
    gains = sum(_gain(x, y) for x, y in zip(gs, hs))
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    values = [x[i, j] / (y[i, j] + PENALTY) for x, y in zip(gs, hs)]
    out = np.empty((n, n))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gains[i, j])


def fit(rows: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Fit on feature rows and 0/1 labels. No rows: every score is one half; one label only: near that label."""
    model = AdditiveModel([_cuts(rows[:, f], BINS) for f in range(rows.shape[1])], [_cuts(rows[:, f], PAIR_BINS) for f in range(rows.shape[1])])
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    model.intercept = float(np.log(mean / (1 - mean)))
    model.tables = np.zeros((rows.shape[1], BINS))
    if not len(labels):
        return model
    bins = [np.searchsorted(c, rows[:, f], side="right") for f, c in enumerate(model.edges)]
    coarse = [np.searchsorted(c, rows[:, f], side="right") for f, c in enumerate(model.pair_edges)]
    total = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(CYCLES):
        for f, own in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(own, g, BINS), np.bincount(own, h, BINS))
            model.tables[f] += step
            total += step[own]
    g, h = slopes()
    flat = {(i, j): coarse[i] * PAIR_BINS + coarse[j] for i, j in combinations(range(rows.shape[1]), 2)}
    square = lambda own, v: np.bincount(own, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = {pair: _quadrants(square(own, g), square(own, h))[1] for pair, own in flat.items()}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_CYCLES):
        for k, pair in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(square(flat[pair], g), square(flat[pair], h))[0]
            model.pair_tables[k] += step
            total += step.ravel()[flat[pair]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """Adds the column ``features`` (array<float>, see FEATURES) of the whole text to every row, in one narrow pass."""
    schema = docs.drop("features").withColumn("features", F.array(F.lit(0.0).cast("float"))).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = text_features(*utf8_of(batch.column(batch.schema.get_field_index("text")))).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
            yield pa.record_batch([*batch.columns, lists], names)

    return docs.drop("features").mapInArrow(frugal(run), schema)


def with_scores(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """Replaces ``features`` by score and predicted (1 from KEEP on)."""
    kept = rows.drop("score", "predicted")
    schema = kept.drop("features").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(1)).schema
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("features")
            features = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            score = shared.value.score(features.astype(np.float64))
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*others, pa.array(score), pa.array((score >= KEEP).astype(np.int32))], schema.names)

    return kept.mapInArrow(frugal(run), schema)


def with_text_scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds score and predicted of the whole text to every row, in one pass: the features never leave the worker.

    Existing columns of these names are replaced; null texts are scored as empty ones.
    """
    kept = docs.drop("score", "predicted")
    schema = kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(1)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = text_features(*utf8_of(batch.column(batch.schema.get_field_index("text")))).astype(np.float32)
            score = model.score(rows.astype(np.float64))
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= KEEP).astype(np.int32))], schema.names)

    return kept.mapInArrow(frugal(run), schema)


def learn(features: DataFrame, labels: DataFrame) -> AdditiveModel:
    """Fit on rows (doc_id, features) with a quality label, a hash sample of FIT_ROWS of them in expectation.

    A doc_id with several labels counts as 1 only if all of them are; null labels and null doc_ids are left out.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = features.select("doc_id", "features").join(marks, "doc_id")
    n = known.count()
    places = 1 << 20
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(places)) < int(places * FIT_ROWS / n))
    got = known.select("doc_id", "features", "quality").toArrow().sort_by("doc_id")
    rows = got["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(rows.astype(np.float64), (got["quality"].to_numpy() >= 1).astype(np.float64))


def document_quality(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """Columns doc_id, held_out, score, predicted of every document; learns from labels of rows not held out.

    Null texts are scored as empty ones. Repeated rows come out once each. Without labels every score is one half.
    """
    rows = stored(with_features(docs.select("doc_id", held_out.alias("held_out"), "text")).drop("text"), "features")
    model = learn(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()), labels)
    return with_scores(rows, model)
