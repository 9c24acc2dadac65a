"""Order-dependent operators that never put one key's whole history in one task.

Rows of a key are cut into time segments. Window functions run per (key, segment);
what has to cross a border is carried over by a second, much smaller window over one
row per (key, non-empty segment). A key that owns a third of all rows is therefore
spread over as many tasks as it has segments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MICROS = 1_000_000
DEFAULT_SEGMENT_SECONDS = 3600

_US = "_us"
_SEG = "_seg"


def micros(ts: Column | str) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def _segment(us: Column, seconds: int) -> Column:
    return F.floor(us / F.lit(seconds * MICROS)).cast("long")


def _present(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).isNotNull()
    return cond


def gap_stats(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    rapid_below: float = 10.0,
    segment_seconds: int = DEFAULT_SEGMENT_SECONDS,
) -> DataFrame:
    """Statistics of the seconds between consecutive rows of each key.

    Rows that share a timestamp are folded into a weight first, so a pile of equal
    timestamps shrinks before the shuffle; each fold of w rows holds w-1 gaps of zero.
    """
    keys = list(keys)
    folded = (
        df.where(_present(keys) & F.col(ts).isNotNull())
        .select(*keys, micros(ts).alias(_US))
        .groupBy(*keys, _US)
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn(_SEG, _segment(F.col(_US), segment_seconds))
    )
    in_segment = W.partitionBy(*keys, _SEG).orderBy(_US)
    gap = (F.col(_US) - F.lag(_US).over(in_segment)) / F.lit(float(MICROS))
    gapped = folded.withColumn("_gap", gap)
    per_segment = gapped.groupBy(*keys, _SEG).agg(
        F.sum("_w").alias("_n"),
        F.sum(F.col("_w") - 1).alias("_zeros"),
        F.count("_gap").alias("_pos"),
        F.sum("_gap").alias("_sum"),
        F.sum(F.col("_gap") * F.col("_gap")).alias("_sq"),
        F.min("_gap").alias("_min"),
        F.count_if(F.col("_gap") < rapid_below).alias("_rapid"),
        F.max(F.struct(F.col("_gap").alias("gap"), (-F.col(_US)).alias("neg_us"))).alias("_widest"),
        F.min(_US).alias("_first"),
        F.max(_US).alias("_last"),
    )
    across = W.partitionBy(*keys).orderBy(_SEG)
    border = (F.col("_first") - F.lag("_last").over(across)) / F.lit(float(MICROS))
    joined = per_segment.withColumn("_border", border)
    zeros = F.sum("_zeros")
    stats = joined.groupBy(*keys).agg(
        F.sum("_n").alias("n_events"),
        zeros.alias("_z"),
        (F.sum("_pos") + F.count("_border")).alias("n_positive_gaps"),
        (F.coalesce(F.sum("_sum"), F.lit(0.0)) + F.coalesce(F.sum("_border"), F.lit(0.0))).alias("_total"),
        (
            F.coalesce(F.sum("_sq"), F.lit(0.0)) + F.coalesce(F.sum(F.col("_border") * F.col("_border")), F.lit(0.0))
        ).alias("_squares"),
        F.least(F.min("_min"), F.min("_border")).alias("_min_positive"),
        (F.sum("_rapid") + F.count_if(F.col("_border") < rapid_below)).alias("_rapid"),
        F.greatest(
            F.max(F.when(F.col("_widest.gap").isNotNull(), F.col("_widest"))),
            F.max(
                F.when(
                    F.col("_border").isNotNull(),
                    F.struct(F.col("_border").alias("gap"), (-F.col("_first")).alias("neg_us")),
                )
            ),
        ).alias("_widest"),
        F.min("_first").alias("first_us"),
        F.max("_last").alias("last_us"),
    )
    n_gaps = F.col("n_positive_gaps") + F.col("_z")
    return stats.select(
        *keys,
        "n_events",
        n_gaps.alias("n_gaps"),
        "n_positive_gaps",
        F.when(F.col("_z") > 0, F.lit(0.0)).otherwise(F.col("_min_positive")).alias("min_gap"),
        F.try_divide(F.col("_total"), n_gaps).alias("mean_gap"),
        _deviation("_total", "_squares", n_gaps, 1).alias("std_gap"),
        _deviation("_total", "_squares", n_gaps, 0).alias("pop_std_gap"),
        F.try_divide(F.col("_total"), F.col("n_positive_gaps")).alias("mean_positive_gap"),
        _deviation("_total", "_squares", F.col("n_positive_gaps"), 1).alias("std_positive_gap"),
        (F.col("_rapid") + F.when(F.lit(rapid_below) > 0, F.col("_z")).otherwise(F.lit(0))).alias("rapid_gaps"),
        F.col("_widest.gap").alias("widest_gap"),
        (-F.col("_widest.neg_us")).alias("widest_gap_end_us"),
        "first_us",
        "last_us",
    )


def _deviation(total: str, squares: str, n: Column, ddof: int) -> Column:
    spread = F.greatest(F.col(squares) - F.col(total) * F.col(total) / n, F.lit(0.0))
    return F.when(n > ddof, F.sqrt(spread / (n - ddof)))


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    segment: str,
    summaries: Mapping[str, Column],
    carried: Mapping[str, Column],
) -> DataFrame:
    """Add to each row what the other segments of its key hand over.

    `summaries` are aggregates of one (key, segment); `carried` are expressions over the
    summary names, evaluated in a window over the segments of the key in order.
    """
    keys = list(keys)
    per_segment = df.groupBy(*keys, segment).agg(*[c.alias(n) for n, c in summaries.items()])
    handed = per_segment.select(*keys, segment, *[c.alias(n) for n, c in carried.items()])
    return df.join(handed, [*keys, segment])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
    ts: str = "ts",
    segment_seconds: int = DEFAULT_SEGMENT_SECONDS * 24,
) -> DataFrame:
    """Each row with the chosen columns of the row before it, as `prev_<column>`."""
    keys = list(keys)
    base = df.where(_present(keys) & F.col(ts).isNotNull()).withColumn(_SEG, _segment(micros(ts), segment_seconds))
    order = F.struct(*[F.col(c) for c in order_by])
    payload = F.struct(*[F.col(c) for c in columns])
    across = W.partitionBy(*keys).orderBy(_SEG)
    carried = with_carry(
        base,
        keys,
        _SEG,
        {"_last_payload": F.max_by(payload, order)},
        {"_carry": F.lag("_last_payload").over(across)},
    )
    in_segment = W.partitionBy(*keys, _SEG).orderBy(*order_by)
    previous = F.coalesce(F.lag(payload).over(in_segment), F.col("_carry"))
    out = carried.withColumn("_prev", previous)
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    ts: str = "ts",
    name: str = "row_index",
    segment_seconds: int = DEFAULT_SEGMENT_SECONDS * 24,
) -> DataFrame:
    """Exact 0-based position of each row inside its key, and the size of the key."""
    keys = list(keys)
    base = df.where(_present(keys) & F.col(ts).isNotNull()).withColumn(_SEG, _segment(micros(ts), segment_seconds))
    before = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    carried = with_carry(
        base,
        keys,
        _SEG,
        {"_n": F.count(F.lit(1))},
        {
            "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_key_rows": F.sum("_n").over(W.partitionBy(*keys)),
        },
    )
    in_segment = W.partitionBy(*keys, _SEG).orderBy(*order_by)
    return carried.select(
        *df.columns,
        (F.col("_offset") + F.row_number().over(in_segment) - 1).alias(name),
        F.col("_key_rows").alias("key_rows"),
    )


def neighbour_frames(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    before: int,
    after: int,
    frames: Mapping[str, tuple[Column, int, int]],
    chunk_rows: int = 10_000,
) -> DataFrame:
    """Row frames over an indexed key, evaluated in chunks of at most chunk_rows + before + after rows.

    `frames` maps a name to (aggregate, first, last) as in rowsBetween. Rows next to a
    chunk border are copied into the neighbour chunk as context and dropped afterwards.
    """
    keys = list(keys)
    home = F.floor(F.col(index) / chunk_rows)
    low = F.floor((F.col(index) - F.lit(after)) / chunk_rows)
    high = F.floor((F.col(index) + F.lit(before)) / chunk_rows)
    copies = df.withColumn("_home", home.cast("long")).withColumn(
        "_chunk", F.explode(F.sequence(low.cast("long"), high.cast("long")))
    )
    window = W.partitionBy(*keys, "_chunk").orderBy(index)
    framed = copies.select(
        "*", *[agg.over(window.rowsBetween(lo, hi)).alias(n) for n, (agg, lo, hi) in frames.items()]
    )
    return framed.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def range_profile(
    df: DataFrame,
    keys: Sequence[str],
    anchor: Column,
    anchor_columns: Sequence[str],
    measures: Mapping[str, Column],
    before_seconds: float = 0.0,
    after_seconds: float = 0.0,
    include_start: bool = False,
    next_of: Mapping[str, Column] | None = None,
    ts: str = "ts",
    segment_seconds: int = DEFAULT_SEGMENT_SECONDS,
) -> DataFrame:
    """For each anchor row, sums of `measures` over the rows of its key in a time range around it.

    The range is (t - before, t + after], or [t - before, t + after] with `include_start`.
    No pairs are built: a sum over a range is the difference of two running sums, so two
    query points per anchor are sorted among the rows of the key. `next_of` adds, as
    `<name>_us`, the time of the first row after the anchor for which a flag holds.
    `anchor_columns` must identify an anchor inside its key.
    """
    keys, anchor_columns = list(keys), list(anchor_columns)
    next_of = dict(next_of or {})
    source = df.where(_present(keys) & F.col(ts).isNotNull()).withColumn(_US, micros(ts))
    folded = source.groupBy(*keys, _US).agg(
        *[F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"_m_{n}") for n, c in measures.items()],
        *[F.max(F.coalesce(c, F.lit(False))).alias(f"_f_{n}") for n, c in next_of.items()],
    )
    shift = -1 if include_start else 0
    start = F.col(_US) - F.lit(int(before_seconds * MICROS)) + F.lit(shift)
    end = F.col(_US) + F.lit(int(after_seconds * MICROS))
    points = (
        source.where(F.coalesce(anchor, F.lit(False)))
        .select(
            *keys,
            *[c for c in anchor_columns if c not in keys],
            F.col(_US).alias("_anchor_us"),
            F.explode(
                F.array(
                    F.struct(F.lit(-1).alias("side"), start.alias("at")),
                    F.struct(F.lit(1).alias("side"), end.alias("at")),
                    *([F.struct(F.lit(0).alias("side"), F.col(_US).alias("at"))] if next_of else []),
                )
            ).alias("_p"),
        )
        .select("*", F.col("_p.side").alias("_side"), F.col("_p.at").alias(_US))
        .drop("_p")
    )
    mixed = folded.unionByName(points, allowMissingColumns=True).withColumn(
        _SEG, _segment(F.col(_US), segment_seconds)
    )
    is_point = F.col("_side").isNotNull()
    measure_names = [f"_m_{n}" for n in measures]
    flag_names = [f"_f_{n}" for n in next_of]
    before = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(1, W.unboundedFollowing)
    carried = with_carry(
        mixed,
        keys,
        _SEG,
        {
            **{m: F.sum(m) for m in measure_names},
            **{f: F.min(F.when(F.col(f), F.col(_US))) for f in flag_names},
        },
        {
            **{f"{m}_before": F.coalesce(F.sum(m).over(before), F.lit(0.0)) for m in measure_names},
            **{f"{f}_later": F.min(f).over(later) for f in flag_names},
        },
    )
    # events at a time come before the query points of that time
    ordered = W.partitionBy(*keys, _SEG).orderBy(_US, is_point.cast("int"))
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    ahead = ordered.rowsBetween(1, W.unboundedFollowing)
    running = carried.select(
        *keys,
        *[c for c in anchor_columns if c not in keys],
        "_anchor_us",
        "_side",
        *[
            (F.col(f"{m}_before") + F.coalesce(F.sum(m).over(so_far), F.lit(0.0))).alias(f"{m}_run")
            for m in measure_names
        ],
        *[
            F.coalesce(F.min(F.when(F.col(f), F.col(_US))).over(ahead), F.col(f"{f}_later")).alias(f"{f}_next")
            for f in flag_names
        ],
    ).where(is_point)
    return running.groupBy(*keys, *[c for c in anchor_columns if c not in keys], "_anchor_us").agg(
        *[F.sum(F.col("_side") * F.col(f"_m_{n}_run")).alias(n) for n in measures],
        *[F.max(F.when(F.col("_side") == 0, F.col(f"_f_{n}_next"))).alias(f"{n}_us") for n in next_of],
    ).withColumnRenamed("_anchor_us", "anchor_us")


def distinct_in_following(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    anchor: Column,
    anchor_columns: Sequence[str],
    within_seconds: float,
    extra: Mapping[str, Column] | None = None,
    ts: str = "ts",
    segment_seconds: int = DEFAULT_SEGMENT_SECONDS,
) -> DataFrame:
    """Distinct `value`s in [t, t + within] for each anchor, without holding the sets.

    An occurrence at s whose previous occurrence of the same value was at p counts for the
    anchors in (p, s] that are no further than `within` before s. These stretches do not
    overlap per value, so the distinct count at t is a running sum of +1 and -1 steps.
    """
    keys = list(keys)
    width = int(within_seconds * MICROS)
    occurrences = (
        df.where(_present([*keys, value]) & F.col(ts).isNotNull())
        .select(*keys, value, micros(ts).alias("_at"))
        .distinct()
        .withColumn("_t", F.timestamp_micros("_at"))
    )
    with_prev = previous_row(occurrences, [*keys, value], ["_at"], ["_at"], ts="_t", segment_seconds=segment_seconds)
    begin = F.greatest(F.coalesce(F.col("prev__at") + 1, F.col("_at") - width), F.col("_at") - width)
    steps = with_prev.select(
        *keys,
        F.explode(
            F.array(
                F.struct(begin.alias("at"), F.lit(1.0).alias("step")),
                F.struct((F.col("_at") + 1).alias("at"), F.lit(-1.0).alias("step")),
            )
        ).alias("_s"),
    ).select(*keys, F.timestamp_micros("_s.at").alias(ts), F.col("_s.step").alias("_step"))
    anchors = df.where(F.coalesce(anchor, F.lit(False))).select(
        *keys, *[c for c in anchor_columns if c not in keys], ts
    )
    mixed = steps.withColumn("_is_anchor", F.lit(False)).unionByName(
        anchors.withColumn("_is_anchor", F.lit(True)), allowMissingColumns=True
    )
    # everything up to and including t: the range reaches back beyond any step
    return running_total(
        mixed, keys, F.col("_is_anchor"), anchor_columns, {f"distinct_{value}": F.col("_step")}, ts, segment_seconds
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    anchor: Column,
    anchor_columns: Sequence[str],
    measures: Mapping[str, Column],
    ts: str = "ts",
    segment_seconds: int = DEFAULT_SEGMENT_SECONDS,
) -> DataFrame:
    """Sums of `measures` over all rows of the key up to and including each anchor's time."""
    keys, anchor_columns = list(keys), list(anchor_columns)
    names = list(measures)
    marked = df.withColumn(_US, micros(ts)).withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    steps = (
        marked.where(~F.col("_anchor"))
        .groupBy(*keys, _US)
        .agg(*[F.sum(c).alias(f"_m_{n}") for n, c in measures.items()])
    )
    anchors = marked.where("_anchor").select(*keys, *[c for c in anchor_columns if c not in keys], _US, "_anchor")
    mixed = steps.unionByName(anchors, allowMissingColumns=True).withColumn(
        _SEG, _segment(F.col(_US), segment_seconds)
    )
    before = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    carried = with_carry(
        mixed,
        keys,
        _SEG,
        {f"_s_{n}": F.sum(f"_m_{n}") for n in names},
        {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)) for n in names},
    )
    ordered = W.partitionBy(*keys, _SEG).orderBy(_US, F.coalesce(F.col("_anchor"), F.lit(False)).cast("int"))
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    return carried.select(
        *keys,
        *[c for c in anchor_columns if c not in keys],
        F.col(_US).alias("anchor_us"),
        "_anchor",
        *[
            (F.col(f"_b_{n}") + F.coalesce(F.sum(f"_m_{n}").over(so_far), F.lit(0.0))).alias(n) for n in names
        ],
    ).where("_anchor").drop("_anchor")
