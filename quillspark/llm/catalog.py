"""Queries over the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chroma, decontaminate, fm_dedup, hard_negatives, html_blocks, merkle, minhash, pii, quality, rules, sentencepiece_codec, suffix_dedup, toxicity
from quillspark.llm.shared import table


def op2_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.dedup_windows(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, sf_dir, "pages"))


def op8_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality.quality(table(spark, sf_dir, "documents"), quality.grades(labels))


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.align(chroma.recordings(table(spark, sf_dir, "embeddings")))


def op11_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_feistel_pseudonyms,
        op2_fm_index_dedup,
        op3_ordinal_quality,
        op4_suffix_array_dedup,
        op5_sentencepiece_codec,
        op6_minhash_near_dedup,
        op7_chroma_fingerprints,
        op8_toxicity_trees,
        op9_bm25_decontamination,
        op10_html_blocks,
        op11_isolation_rules,
        op12_merkle_manifest,
        op13_hard_negatives,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": merkle.SQL, "op13_hard_negatives": hard_negatives.SQL}
