"""A training corpus from documents: each stage takes what the one before kept.

quality    documents that the classifier rejects go
near_dups  one document (the smallest doc_id) of each group of near duplicates (5-word shingles, similarity 0.8) stays
benchmark  documents into which a benchmark item leaks go
secrets    spans of secrets are replaced by their kind in brackets; the documents stay
bpe        token ids of every document that is left

Defined results: null and empty texts pass through all stages like any others (the classifier scores them, they have no near duplicates, leaks or secrets,
and no ids); rows without doc_id are no near duplicates and no leaks; of repeated rows of one doc_id all stay or go together; an empty table gives no rows; further columns
are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontamination, minhash, quality, secrets
from tidelog.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't the smallest of their group go; of rows of one doc_id that is kept, all stay."""
    out = minhash.near_duplicates(docs, size=5, percent=80)
    gone = stored(out.where("not kept").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("near_dups", near_duplicate_stage), ("benchmark", benchmark_stage), ("secrets", secret_stage), ("bpe", bpe_stage)]

#: The classifier, MinHash and the byte-level coder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
