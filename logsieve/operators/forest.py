"""Isolation forest: trees grown on small samples, sent to all tasks, rows scored in Arrow batches.

After Liu, Ting and Zhou, "Isolation Forest" (2008). What comes to the driver is the sample
only, at most trees x rows per tree, whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.density import standardized
from logsieve.operators.stats import order_statistics, with_scalars

TREES, SAMPLE_ROWS, SEED, CONTAMINATION, MIN_ROWS = 100, 256, 42, 0.1, 10


def _mean_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """A tree as a list of nodes (feature, cut, left, right, depth added at a leaf)."""
    nodes: list[tuple] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, depth + _mean_depth(len(part))))
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(part) <= 1 or not len(usable):
            return at
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        below = part[:, feature] < cut
        left = add(part[below], depth + 1)
        right = add(part[~below], depth + 1)
        nodes[at] = (feature, cut, left, right, 0.0)
        return at

    add(rows, 0)
    return nodes


def depths(tree: list[tuple], rows: np.ndarray) -> np.ndarray:
    feature, cut, left, right, depth = (np.array(x) for x in zip(*tree, strict=True))
    at = np.zeros(len(rows), dtype=np.int64)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return depth[at]
        value = rows[np.arange(len(rows)), np.where(inner, f, 0)]
        at = np.where(inner, np.where(value < cut[at], left[at], right[at]), at)


def forest_scores(df: DataFrame, key: str, features: Sequence[str], trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(key, score) with scores near one for rows that are easy to set apart."""
    columns = [f"z_{f}" for f in features]
    scaled = standardized(df, features).select(key, *columns)
    # the rows with the smallest hashes are a sample that does not depend on how the data is split
    sample = scaled.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(trees * sample_rows).select(*columns).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    size = min(sample_rows, len(sample))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    forest = [grow(sample[rng.choice(len(sample), size, replace=False)], rng, limit) for _ in range(trees)] if size else []
    shared = df.sparkSession.sparkContext.broadcast((forest, _mean_depth(size) or 1.0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, norm = shared.value
        for batch in batches:
            rows = batch[columns].to_numpy(dtype=float)
            total = np.zeros(len(rows))
            for tree in grown:
                total += depths(tree, rows)
            yield pd.DataFrame({key: batch[key], "score": np.power(2.0, -total / max(len(grown), 1) / norm)})

    kind = dict(df.dtypes)[key]
    return scaled.mapInPandas(score, f"`{key}` {kind}, score double")


def forest_outliers(
    df: DataFrame, key: str, features: Sequence[str], contamination: float = CONTAMINATION, min_rows: int = MIN_ROWS, **kwargs
) -> DataFrame:
    """The share of rows with the highest scores, cut at the exact order statistic."""
    from logsieve.session import cut_lineage

    scores = cut_lineage(forest_scores(df, key, features, **kwargs))
    kept = round((1 - contamination) * 1000)
    cut = order_statistics(scores, [], "score", {"_cut": (kept, 1000)}).select("_cut", "n_values")
    found = with_scalars(scores, cut).where((F.col("n_values") >= min_rows) & (F.col("score") >= F.col("_cut"))).select(key, "score")
    return df.join(found, key)


def traffic_outliers(df: DataFrame, key: str, features: Sequence[str] = ("bytes_sent", "bytes_received", "packet_count"), **kwargs) -> DataFrame:
    """Unusual traffic; rows that lack a feature are left out."""
    complete = df
    for f in features:
        complete = complete.where(F.col(f).isNotNull())
    return forest_outliers(complete, key, features, **kwargs)


def generic_outliers(df: DataFrame, key: str, **kwargs) -> DataFrame:
    """Outliers over all numeric columns, missing values as zero."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    features = [n for n, t in df.dtypes if n != key and (t in numeric or t.startswith("decimal"))]
    return forest_outliers(df, key, features, **kwargs)
