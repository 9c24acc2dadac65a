"""Points without enough neighbours, exactly, for any number of features.

Cells are so small that all points of a cell are neighbours. A cell with enough points
makes all of them core points without looking at any pair; only the few points of sparse
cells are compared with what lies around them, at most a fixed number of such points per
cell, so the work grows linearly however many points share a cell.

Up to MAX_DIMENSIONS features what lies around is found by the cells next to a cell, whose number grows as a power of the
features. With more, space is cut in boxes by the medians of a sample, feature by feature; every point goes to its
own box, those that are compared with it also to the boxes within eps of them, and points of a box are compared in blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.stats import with_scalars
from logsieve.session import cut_lineage

MAX_DIMENSIONS = 3  # by cells
SALTS = 16
SAMPLE_POINTS = 50_000  # by which the boxes are cut; decides the work, never the result
BOX_POINTS = 4_096  # of a box, about, as far as the sample can tell; more are compared in blocks of so many
LEAF_POINTS = 128  # of a block, that a probe is compared with if it is near enough to the box around them


def standardized(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less their mean over their population deviation; missing values count as zero."""
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    moments = filled.agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    joined = with_scalars(filled, moments)
    scaled = {
        f"z_{f}": F.when(F.col(f"_s_{f}") > 0, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(F.lit(0.0)) for f in features
    }
    return joined.withColumns(scaled).drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])


def cluster_noise(
    df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5, min_points: int = 5, min_rows: int = 20, scale: bool = True
) -> DataFrame:
    """Rows that are neither core (at least `min_points` within eps, themselves included) nor near a core row.

    One row of df for each, with `neighbours`. Missing values count as zero where the features are scaled, else their rows
    are left out. Fewer rows than `min_rows` + 1 have no noise.
    """
    features = list(features)
    points = standardized(df, features) if scale else df.withColumns({f"z_{f}": F.col(f).cast("double") for f in features})
    dims = len(features)
    if dims > MAX_DIMENSIONS:
        noise = _noise_in_boxes(points.select(F.col(key).alias("_id"), *(f"z_{f}" for f in features)), [f"z_{f}" for f in features], eps, min_points)
        enough = df.agg((F.count(F.lit(1)) > min_rows).alias("_enough"))
        return with_scalars(df.join(noise.withColumnRenamed("_id", key), key), enough).where("_enough").drop("_enough")
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    reach = math.ceil(math.sqrt(dims))
    z = [f"z_{f}" for f in features]
    cells = [f"_c{i}" for i in range(dims)]
    placed = points.select(
        F.col(key).alias("_id"), *z, *[F.floor(F.col(c) / side).cast("long").alias(n) for c, n in zip(z, cells, strict=True)],
        F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).alias("_salt"),
    )
    counts = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))
    sparse_cells = counts.where(F.col("_n") < min_points).select(*cells, salts.alias("_salt"))
    dense_cells = counts.where(F.col("_n") >= min_points).select(*cells)
    sparse = placed.join(sparse_cells, [*cells, "_salt"], "left_semi")
    offsets = list(itertools.product(range(-reach, reach + 1), repeat=dims))
    around = F.explode(F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(off, cells, strict=True)]) for off in offsets]))

    def probes(rows: DataFrame) -> DataFrame:
        """Each row once per cell around it and salt."""
        spread = rows.select(F.col("_id").alias("_p"), *[F.col(c).alias(f"_p{c}") for c in z], *cells, around.alias("_o"))
        moved = spread.select("_p", *[f"_p{c}" for c in z], *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in cells])
        return moved.select("*", salts.alias("_salt"))

    near = F.lit(0.0)
    for c in z:
        near = near + (F.col(c) - F.col(f"_p{c}")) * (F.col(c) - F.col(f"_p{c}"))
    within = near <= eps * eps
    met = probes(sparse).join(placed.select("_id", *z, *cells, "_salt"), [*cells, "_salt"]).where(within)
    tallied = met.groupBy("_p", *cells).agg(F.count(F.lit(1)).alias("_k"))
    marked = tallied.join(dense_cells.withColumn("_dense", F.lit(1)), cells, "left")
    judged = marked.groupBy("_p").agg(F.sum("_k").alias("neighbours"), F.max(F.coalesce("_dense", F.lit(0))).alias("_by_dense"))
    lonely = judged.where((F.col("neighbours") < min_points) & (F.col("_by_dense") == 0)).select("_p", "neighbours")
    core_sparse = judged.where(F.col("neighbours") >= min_points).select(F.col("_p").alias("_id"))
    lonely_rows = sparse.join(lonely.select(F.col("_p").alias("_id")), "_id", "left_semi")
    core_rows = sparse.join(core_sparse, "_id", "left_semi")
    saved = probes(lonely_rows).join(core_rows.select(*z, *cells, "_salt"), [*cells, "_salt"]).where(within).select("_p").distinct()
    noise = lonely.join(saved, "_p", "left_anti").withColumnRenamed("_p", key)
    found = df.join(noise, key)
    enough = df.agg((F.count(F.lit(1)) > min_rows).alias("_enough"))
    return with_scalars(found, enough).where("_enough").drop("_enough")


def cut_boxes(points: np.ndarray, boxes: int, eps: float) -> list | None:
    """A tree of cuts (feature, value, below, above), None for a box: at the median of the feature that spreads most.

    A cut is of use only if both sides are as wide as the seam of eps around it.
    """
    if boxes < 2 or len(points) < 2:
        return None
    spread = np.ptp(points, axis=0)
    feature = int(spread.argmax())
    if spread[feature] <= 2 * eps:
        return None
    value = float(np.median(points[:, feature]))
    low = points[:, feature] <= value
    if low.all() or not low.any():
        return None
    return [feature, value, cut_boxes(points[low], boxes // 2, eps), cut_boxes(points[~low], boxes - boxes // 2, eps)]


def _dealing(tree, dims: int, margin: float):
    """(box, point, weight, dense): each point with all boxes that come within the margin of it."""

    def boxes_of(x: np.ndarray):
        waiting, number = [(tree, np.arange(len(x)))], 0
        while waiting:
            node, rows = waiting.pop()
            if node is None:
                if len(rows):
                    yield number, rows
                number += 1
                continue
            feature, value, below, above = node
            c = x[rows, feature]
            waiting += [(above, rows[c > value - margin]), (below, rows[c <= value + margin])]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(dims)], axis=1) if batch.num_rows else np.zeros((0, dims))
            for number, rows in boxes_of(x):
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), *taken.columns], ["_box", *batch.schema.names])

    return run


def _leaves(x: np.ndarray):
    """Rows of x in groups of at most LEAF_POINTS that lie together."""
    waiting = [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= LEAF_POINTS:
            if len(rows):
                yield rows
            continue
        c = x[rows, int(np.ptp(x[rows], axis=0).argmax())]
        order = np.argpartition(c, len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def _comparing(z: list[str], eps: float):
    """Per probe what lies within eps in one block: weight of all, and whether any of it is dense. Probes that meet nothing are left out."""

    def run(key: tuple, probes: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        count, dense = np.zeros(len(probes), np.int64), np.zeros(len(probes), bool)
        weight, flag = others["_w"].to_numpy(), others["_dense"].to_numpy(bool)
        ps, ys = probes[z].to_numpy(float).reshape(-1, len(z)), others[z].to_numpy(float).reshape(-1, len(z))
        for rows in _leaves(ys):
            y, w, f = ys[rows], weight[rows], flag[rows]
            off = np.maximum(np.maximum(y.min(axis=0) - ps, ps - y.max(axis=0)), 0)
            able = np.flatnonzero((off * off).sum(axis=1) <= eps * eps * (1 + 1e-9))  # the others are too far from all of the leaf
            step = max(1, (1 << 20) // len(rows))
            for a in range(0, len(able), step):
                some = able[a : a + step]
                near = np.zeros((len(some), len(rows)))
                for i in range(len(z)):
                    near += (y[:, i] - ps[some, i][:, None]) ** 2
                within = near <= eps * eps
                count[some] += within @ w
                dense[some] |= within @ f
        return probes[z].assign(_k=count, _by_dense=dense)[count > 0]

    return run


def _met(probes: DataFrame, others: DataFrame, z: list[str], tree, eps: float) -> DataFrame:
    """Each probe that has others within eps with `_k`, their weight, and `_by_dense`. Blocks of a box are dealt over the tasks.

    The probes, which are few, go to all boxes that come within eps of them, the others to their own box only.
    """
    kinds = ", ".join(f"{c} double" for c in z)
    around = probes.select(*z).mapInArrow(_dealing(tree, len(z), eps * (1 + 1e-9)), f"_box int, {kinds}")
    home = others.select(*z, "_w", "_dense").mapInArrow(_dealing(tree, len(z), 0.0), f"_box int, {kinds}, _w long, _dense boolean")
    # at most as many rows as boxes of the tree
    parts, blocks = ({r["_box"]: -(-r["count"] // BOX_POINTS) for r in x.groupBy("_box").count().collect()} for x in (around, home))
    cuts = F.broadcast(probes.sparkSession.createDataFrame([(b, n, blocks[b]) for b, n in parts.items() if b in blocks], "_box int, _parts long, _blocks long"))
    # what fills a block meets what fills another: each part of the probes with each block of the others
    left = around.join(cuts, "_box").withColumn("_part", F.pmod(F.xxhash64(*z), F.col("_parts")))
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_parts", "_blocks")
    right = home.join(cuts, "_box").withColumn("_block", F.pmod(F.xxhash64(*z, F.lit(1)), F.col("_blocks")))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts", "_blocks")
    keys = ["_box", "_block", "_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_comparing(z, eps), f"{kinds}, _k long, _by_dense boolean")
    return found.groupBy(*z).agg(F.sum("_k").alias("_k"), F.max("_by_dense").alias("_by_dense"))


def _noise_in_boxes(points: DataFrame, z: list[str], eps: float, min_points: int) -> DataFrame:
    """(_id, neighbours) of the noise. Equal points are one with a weight until the end."""
    side = eps / math.sqrt(len(z)) * (1 - 1e-9)
    present = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in z))
    cells = [F.floor(F.col(c) / side).cast("long").alias(f"_cell{i}") for i, c in enumerate(z)]
    names = [f"_cell{i}" for i in range(len(z))]
    distinct = present.groupBy(*z).agg(F.count(F.lit(1)).alias("_w")).select(*z, "_w", *cells)
    dense = present.select(*cells).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select(*names, F.lit(True).alias("_dense"))
    # of the cells with the most points only the distinct ones are left, each once
    weighted = cut_lineage(distinct.join(dense, names, "left").select(*z, "_w", F.coalesce("_dense", F.lit(False)).alias("_dense")))
    sample = weighted.orderBy(F.xxhash64(*z)).limit(SAMPLE_POINTS).select(*z).toPandas().to_numpy()
    tree = cut_boxes(sample, max(1, min(weighted.count() // BOX_POINTS, SAMPLE_POINTS // 16)), eps)
    sparse = weighted.where(~F.col("_dense"))
    judged = cut_lineage(_met(sparse, weighted, z, tree, eps))
    core = judged.where(F.col("_k") >= min_points).select(*z, F.lit(1).cast("long").alias("_w"), F.lit(False).alias("_dense"))
    lonely = judged.where((F.col("_k") < min_points) & ~F.col("_by_dense"))
    saved = _met(lonely, core, z, tree, eps).where(F.col("_k") > 0)
    noise = lonely.select(*z, F.col("_k").alias("neighbours")).join(saved.select(*z), z, "left_anti")
    return present.join(noise, z).select("_id", "neighbours")
