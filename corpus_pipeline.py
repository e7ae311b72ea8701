"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept. All but the last return the columns of `docs`, whatever their names.

In all stages a null or an empty text is a text without words: it is scored as such,
has no near duplicate, holds no benchmark item and no personal data, and has no
tokens. A null doc_id stays null. Repeated rows fare alike, but of rows that agree in
id and text the second stage keeps one. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, minhash, pii, quality, sentencepiece_codec
from quillspark.llm.shared import forget, table, written


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression grades 1 or better with a probability of at least one half."""
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of the five-word shingles): that with the smallest id."""
    return minhash.deduplicated(docs, minhash.STAGE_THRESHOLD)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in `text` replaced by pseudonyms."""
    return pii.with_pseudonyms(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text again."""
    return sentencepiece_codec.checked(docs)


STAGES = [
    ("quality_ordinal", select_quality),
    ("near_dedup_minhash", drop_near_duplicates),
    ("decontaminate_bm25", drop_benchmark_leaks),
    ("pseudonymize_pii", pseudonymize),
    ("tokenize_sentencepiece", tokenize),
]

#: The stages fit models and confirm sets, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
