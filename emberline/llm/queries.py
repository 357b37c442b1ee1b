"""The corpus operators as registered queries, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, licenses, media_columns, packing, pieces, quality, sharding, simhash, token_counts, toxicity, url_filters, whitening
from .common import shared_folder, table

SHARDS = 16


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintained_totals(table(spark, sf_dir, "documents"))


def token_rollup_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of op1 without the vocabulary's counts, which SQL can't express."""
    return token_counts.maintained_totals(table(spark, sf_dir, "documents"), {})


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = media_columns.encode_texts(table(spark, sf_dir, "documents"))
    return media_columns.digest(media_columns.write_blocks(streams, f"{shared_folder(spark)}/emberline/pcm-{uuid.uuid4().hex}"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op11_block_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_lloyd_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), decoded="decoded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_rollup": op1_token_rollup,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_url_filters": op3_url_filters,
    "op4_flac_media": op4_flac_media,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_toxicity_nb_ngrams": op7_toxicity_nb_ngrams,
    "op8_quality_bradley_terry": op8_quality_bradley_terry,
    "op9_simhash_golay": op9_simhash_golay,
    "op10_license_tfidf": op10_license_tfidf,
    "op11_block_lanczos_whitening": op11_block_lanczos_whitening,
    "op12_lloyd_centroids": op12_lloyd_centroids,
    "op13_sentencepiece_spans": op13_sentencepiece_spans,
    "token_rollup_patterns": token_rollup_patterns,
}
ORACLES: dict[str, str] = {
    "op10_license_tfidf": licenses.oracle(),
    "op12_lloyd_centroids": clustering.oracle(),
    "token_rollup_patterns": token_counts.oracle(),
    "op3_url_filters": url_filters.oracle(),
    "op6_template_decontamination": decontamination.oracle(),
}
