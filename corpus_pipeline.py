"""Documents to packed training sequences: stages that are written as Parquet one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import line_dedup, ngram_join, packing, pii, quality
from logsieve.llm.store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(rows: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of documents; the number of characters follows a changed text."""
    if changed:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the cutoffs come from the labels. Null texts have no words and go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(quality.judge(docs, labels, keep_columns=True))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share, but for the largest id; null texts become empty."""
    return _documents(line_dedup.dedup_lines(docs, min_docs=3, min_chars=20), changed=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of similar documents; rows without an id stay."""
    groups = ngram_join.jaccard_join(docs, width=5, percent=75)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return _documents(docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; null texts stay null."""
    return _documents(pii.redact(docs), changed=True)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens, every document in full; null texts are their end token."""
    return packing.pack(docs, TOKENIZER, window=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", shared_lines),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]

#: Token ids can't be made in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), f"stage-{name.replace(' ', '-')}")
    return rows
