"""A training corpus from documents: five stages, each over all that the one before kept.

Each stage reads what its predecessor wrote as Parquet.  All but the last return the
columns of ``documents``; the last returns packed pieces.  What a stage staged in the
shared folder is deleted when the next one begins, since its result is then written.
Texts reach Python workers in small Arrow batches, which a stage sets for the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pricelark.llm import common, jaccard, mixing, packing, paragraphs, quality
from pricelark.llm.queries import table, tokenizer_path

_SCOPES = ("pipeline-quality", "pipeline-jaccard", "pipeline-paragraphs", "pipeline-mixing", "pipeline-packing")


def _begin(spark: SparkSession, scope: str) -> str:
    for other in _SCOPES:
        common.release(spark, other)
    common.small_batches(spark)
    return scope


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go; null and empty texts are scored as empty ones.  Without labels all stay."""
    _begin(spark, _SCOPES[0])
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that link at Jaccard 0.8 on word 5-grams, the first by doc_id (nulls last) stays, and one of rows that repeat; texts without a word stay."""
    return jaccard.keep_first(docs, 5, 0.8, scope=_begin(spark, _SCOPES[1]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; a text left without a word goes, others are untouched."""
    return paragraphs.remove(docs, scope=_begin(spark, _SCOPES[2]))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to meet their source's target weight; a null source is a source of its own."""
    return mixing.mix(docs, scope=_begin(spark, _SCOPES[3]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048; a null or empty text is a piece of the end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), scope=_begin(spark, _SCOPES[4]))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: The classifier, the banding and the packing have no SQL; tests/llm checks run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{common.shared_root(spark)}/pricelark-{spark.sparkContext.applicationId}/run-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
