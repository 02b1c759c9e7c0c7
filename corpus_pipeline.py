"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again for the next
one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memberrisk.llm import common, decontaminate, ngram_join, packing, pii, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by the ordinal model fitted on ``labels``."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more)."""
    return ngram_join.one_per_group(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"), name="pipeline-benchmark")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redact_documents(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of at most 2048 tokens."""
    rows = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), spaced=False)
    return packing.pack(rows, packing.CAPACITY, "pipeline-pack")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_per_group),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("best_fit_packing", pack),
]

#: SQL has neither the fitted models nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{common.shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
