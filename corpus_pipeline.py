"""A corpus pipeline of five stages, each of which applies one operator to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Rows without a doc_id
are deduplicated by their texts. An empty table stays empty in every stage. Columns of ``docs`` besides those that a
stage needs are set aside while it works, so they may have any name and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrade.llm import jaccard_join, language_id, packing, quality_model, secret_scan
from querygrade.llm.common import stored, table
from querygrade.llm.queries import vocabulary
from querygrade.session import ship_package


def _set_aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and ``_rest`` with all others."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others, F.lit(0).alias("_end_of_rest")).alias("_rest"))


def _put_back(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The rows with the columns of ``docs``, in their order."""
    return rows.select(*[F.col(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter and those whose score is below a limit.

    Learns from the rows with a lang. The limit is half the smallest score of all labelled rows whose language was
    found, so that clean texts a little further out than those stay.
    """
    ship_package(spark)
    langs, prototypes = language_id.learn_prototypes(docs)
    needed = ("text", "lang")
    found = stored(language_id.predict_language(_set_aside(docs, *needed), langs, prototypes), "languages")
    own = found.where((F.col("lang") == F.col("lang_pred")) & (F.col("lang_pred") != language_id.UNDETERMINED))
    limit = own.agg(F.min("score")).first()[0] or 0.0
    return _put_back(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= limit / 2)), docs, *needed)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones, scores below its limit."""
    ship_package(spark)
    rows = stored(quality_model.with_features(docs.select("doc_id", "text")).drop("text"), "features")
    model = quality_model.learn(rows.where(F.col("doc_id").isNotNull()), table(spark, sf_dir, "labels"))
    scored = quality_model.with_text_scores(_set_aside(docs, "text"), model)
    return _put_back(scored.where(F.col("predicted") == 1), docs, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of similar texts: of its smallest doc_id (rows without one come last), repeated rows once.

    Every distinct row (doc_id, text) is judged by its own text; of different texts of one doc_id in one class the one
    that a hash puts first stays. Texts without a word are in no class: repeated ones go if they share a doc_id.
    """
    ship_package(spark)
    doc_id, text = F.col("doc_id"), F.col("text")
    needed = ("doc_id", "text")
    rows = _set_aside(docs, *needed).withColumn("_row", F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text))
    classes = jaccard_join.jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class"), (F.col("n_shingles") == 0).alias("_bare")).distinct()
    ids = rows.select("_row", doc_id.isNull().alias("_last"), "doc_id").distinct()
    first = F.min(F.struct("_last", "doc_id", "_row", "_bare")).alias("_first")
    firsts = stored(classes.join(ids, "_row").groupBy("_class").agg(first).select("_first._row", "_first._bare"), "firsts")
    kept = rows.join(firsts, "_row")
    loose = doc_id.isNull() & F.col("_bare")
    once = kept.where(~loose).dropDuplicates(["_row"])
    return _put_back(once.unionByName(kept.where(loose)), docs, *needed)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret, bare numbers of the hex pattern included; n_chars follows the text."""
    clean = _put_back(secret_scan.redact(_set_aside(docs, "text"), numbers=True), docs, "text")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all documents into sequences; a row for each piece."""
    ship_package(spark)
    return packing.packed_pieces(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", hide_secrets),
    ("packing", pack),
]

#: Tokenizers and fitted models have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
