"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram vector binds its letters' vectors, each permuted by
its place; a text's vector bundles its n-grams. A language's prototype bundles the vectors of its texts, each
with the same weight. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import frugal, mix64, text_slices

#: Length of the vectors and letters of an n-gram.
DIMENSIONS = 512
GRAM = 3
UNDETERMINED = "und"

#: Bits of a letter in the code of an n-gram: any code point, 0 for a gap.
_LETTER_BITS = 21
_letters: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """The letter of each code point: its lower-case form, so both cases are alike; everything else is a gap."""
    if not _letters:
        codes = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            char = chr(c)
            if char.isalpha():
                codes[c] = ord(char.lower()[0])
        _letters.append(codes)
    return _letters[0]


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The random vector of each letter: bits of a hash of its code point, as 1 and -1. A gap has one too."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    bits = mix64((letters.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ words)
    spread = (bits[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return spread.reshape(len(letters), DIMENSIONS).astype(np.int8) * 2 - 1


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams of all texts, the text of each, and whether each text has a letter.

    A run of other characters is one gap; each text begins and ends with a gap.
    """
    joined = "\n\n".join(t or "" for t in texts)
    symbols = _symbol_table()[np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[kept].astype(np.int64), owner[kept]
    lettered = np.bincount(owner, weights=symbols > 0, minlength=len(texts)) > 0
    n = len(symbols) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    codes = symbols[:n].copy()
    for k in range(1, GRAM):
        codes = (codes << _LETTER_BITS) | symbols[k : n + k]
    whole = owner[:n] == owner[GRAM - 1 :]
    return codes[whole], owner[:n][whole], lettered


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of some n-grams: letters' vectors, rotated by their distance from the end, multiplied."""
    bound = np.ones((len(codes), DIMENSIONS), np.int8)
    places = [codes >> (_LETTER_BITS * (GRAM - 1 - k)) & ((1 << _LETTER_BITS) - 1) for k in range(GRAM)]
    letters, which = np.unique(np.concatenate(places), return_inverse=True)
    vectors = letter_vectors(letters)
    for k, own in enumerate(which.reshape(GRAM, -1)):
        bound *= np.roll(vectors, GRAM - 1 - k, axis=1)[own]
    return bound


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of texts, scaled to length one, and whether each has a letter."""
    codes, owner, lettered = gram_codes(texts)
    names, place = np.unique(codes, return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for a in range(0, len(texts), 256):
        rows = slice(*np.searchsorted(owner, (a, a + 256)))
        n = min(256, len(texts) - a)
        own, col = np.unique(place[rows], return_inverse=True)
        counts = np.bincount((owner[rows] - a) * len(own) + col, minlength=n * len(own)).reshape(n, len(own)).astype(np.float32)
        for c in range(0, len(own), 4096):  # the widened vectors of so many n-grams at a time
            out[a : a + n] += counts[:, c : c + 4096] @ gram_vectors(names[own[c : c + 4096]]).astype(np.float32)
    norms = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return out / np.maximum(norms, 1e-9)[:, None].astype(np.float32), lettered


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the summed vectors of each language's texts, from weighted n-gram counts."""
    sums: dict[str, np.ndarray] = {}
    for batch in text_slices(batches):
        codes, owner, _ = gram_codes(batch.column(0).to_pylist())
        lengths = np.maximum(np.bincount(owner, minlength=batch.num_rows), 1)
        langs, which = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        weights = (1.0 / lengths)[owner]
        for k, lang in enumerate(langs.tolist()):
            rows = which[owner] == k
            own, col = np.unique(codes[rows], return_inverse=True)
            if len(own):
                bundle = np.bincount(col, weights=weights[rows]) @ gram_vectors(own)
                sums[lang] = sums.get(lang, 0) + bundle
    if sums:
        yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])


def learn_prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and their prototypes of length one, from rows (text, lang) with a language.

    Sums go through Spark as one row for each task and language; the driver gets languages x DIMENSIONS numbers.
    """
    bundles = labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInArrow(frugal(_bundles), "lang string, bundle array<double>")
    sums = bundles.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    table = np.zeros((len(langs), DIMENSIONS))
    for r in sums:
        table[langs.index(r["lang"]), r["pos"]] = r["v"]
    table = table / np.maximum(np.sqrt((table**2).sum(axis=1)), 1e-12)[:, None]
    return langs, table.round(9)


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """Adds lang_pred and score (the cosine, at least 0) to every row of ``docs`` and keeps all its columns.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text when no language was
    learned. Of equal cosines the language first in order wins. Existing columns lang_pred and score are replaced.
    """
    schema = docs.drop("lang_pred", "score").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    names = [f.name for f in schema][:-2]
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_langs, own_prototypes = shared.value
        for batch in text_slices(batches):
            vectors, lettered = text_vectors(batch.column(batch.schema.get_field_index("text")).to_pylist())
            if own_langs:
                cosines = vectors.astype(np.float64) @ own_prototypes.T
                best = cosines.argmax(axis=1)
                score = np.where(lettered, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
                pred = [own_langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
            else:
                score, pred = np.zeros(batch.num_rows), [UNDETERMINED] * batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.drop("lang_pred", "score").mapInArrow(frugal(run), schema)


def held_out(fold: int, folds: int):
    """True where crc32 of the doc_id as text leaves this remainder; rows without a doc_id are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def document_languages(docs: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score: learns from the rows not held out and predicts for all.

    Rows without a doc_id are predicted but not learned from.
    """
    marked = docs.select("doc_id", "text", "lang", held_out(2, 4).alias("held_out"))
    langs, prototypes = learn_prototypes(marked.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict_language(marked.select("doc_id", "held_out", "text"), langs, prototypes).select("doc_id", "held_out", "lang_pred", "score")
