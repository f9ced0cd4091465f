"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querygrade.llm import centroid_clusters, jaccard_join, language_id, packing, piece_codec, piecewise_hash, quality_model, secret_scan, token_alignment, token_files, url_filter, vector_dedup, vector_search
from querygrade.llm.common import table
from querygrade.session import shared_dir, ship_package


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; it is installed at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_model.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), language_id.held_out(0, 5))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.document_languages(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piecewise_hash.document_fingerprints(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.packed_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    folder = shared_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return vector_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))[0]


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return centroid_clusters.cluster_digests(table(spark, sf_dir, "embeddings"))


#: name: (run, SQL). DuckDB SQL cannot say these operators; tests hold them against brute force instead.
LLM_QUERIES = {
    run.__name__: (run, None)
    for run in (
        op1_ngram_jaccard_join, op2_sentencepiece_codec, op3_quality_classifier, op4_language_id, op5_document_fingerprints,
        op6_nearest_neighbours, op7_url_filters, op8_secret_scans, op9_packing, op10_token_files,
    )
}
LLM_QUERIES["op11_vector_dedup"] = (op11_vector_dedup, vector_dedup.near_copies_sql())
LLM_QUERIES["op12_token_alignment"] = (op12_token_alignment, None)
LLM_QUERIES["op13_centroid_clusters"] = (op13_centroid_clusters, centroid_clusters.cluster_sql())
