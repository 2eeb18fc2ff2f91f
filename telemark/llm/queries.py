"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.llm import (
    chat,
    clustering,
    decontaminate,
    exact_dedup,
    language_id,
    line_dedup,
    near_dedup,
    nearest,
    packing,
    quality,
    substring_dedup,
    suffix_dedup,
    vector_codes,
)
from telemark.llm._tables import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents")).drop("kept_text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.links(read(spark, sf_dir, "documents"), near_dedup.Forest(shingle=4))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"), with_text=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report_whole(read(spark, sf_dir, "conversations"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), with_text=False)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(read(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read(spark, sf_dir, "embeddings"))


#: In the order of their numbers.
QUERIES = (
    op1_decontaminate,
    op2_language_id,
    op3_line_dedup,
    op4_near_dedup,
    op5_quality,
    op6_suffix_dedup,
    op7_packing,
    op8_nearest,
    op9_chat,
    op10_substring_dedup,
    op11_centroid_clusters,
    op12_exact_dedup,
    op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.oracle_sql(),
        "op9_chat": chat.oracle_sql(),
        "op11_centroid_clusters": clustering.oracle_sql(),
        "op12_exact_dedup": exact_dedup.oracle_sql(),
        "op13_vector_codes": vector_codes.oracle_sql(),
    }
