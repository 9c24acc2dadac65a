"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_SCHEMA = "digest binary, n_tokens long, version string"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never meets the counts of this one."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def stored_counts(docs: DataFrame, cache_path: str, version: str) -> DataFrame:
    """What the cache holds for a version, one row per digest; no rows where nothing was written yet."""
    spark = docs.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    # two writers may have stored the same text; their counts are equal
    return rows.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def _counting(tokenizer_path: str):
    def run(batches):
        from logsieve.llm.encoding import encoder

        count = encoder(tokenizer_path).count
        for batch in batches:
            counts = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """docs with `n_bytes` (UTF-8) and `n_tokens`, read from the cache at `cache_path`, which gains what it lacked.

    The normalised content is the text itself with null as the empty text, since any further change would change the
    counts. Its digest and that of the tokenizer file are the key. Only digests that are missing are encoded, each
    distinct one once, however many rows share it; a repeated call encodes nothing. Rows are kept as they are: repeated
    rows, null ids and columns of any other name pass through (`n_bytes` and `n_tokens` are replaced if they exist).
    A hot text is one row after the map-side part of the grouping; the join back spreads its rows by adaptive
    splitting, the cache side being one row. Empty tables give empty results.
    """
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    known = stored_counts(docs, cache_path, version).select("digest")
    misses = content.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    misses.mapInArrow(_counting(tokenizer_path), "digest binary, n_tokens long").withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache_path)
    counts = stored_counts(docs, cache_path, version).select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__tokens"))
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("__digest"))
    return rows.join(counts, "__digest", "left").select(*(F.col(f"`{c}`") for c in keep), "n_bytes", F.col("__tokens").alias("n_tokens"))
