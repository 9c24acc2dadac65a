"""Detectors over time buckets. Raw rows are counted per bucket first; windows and
baselines then run over the buckets, whose number depends on the time covered only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.clock import time_bucket
from logsieve.operators.ordered import micros
from logsieve.operators.stats import order_statistics, outlier_test, with_scalars


def volume_anomalies(df: DataFrame, ts: str = "ts", seconds: int = 300, min_buckets: int = 5, high_factor: float = 3):
    """Buckets whose event count is an outlier among all buckets."""
    counts = (
        df.where(F.col(ts).isNotNull())
        .groupBy(time_bucket(F.col(ts), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    median = counts.agg(F.median("events").alias("expected"))
    based = with_scalars(with_scalars(counts, order_statistics(counts, [], "events")), median)
    return based.where((F.col("n_values") >= min_buckets) & outlier_test(F.col("events"))).select(
        "bucket",
        "events",
        "expected",
        F.when(F.col("events") > high_factor * F.col("expected"), "high").otherwise("medium").alias("severity"),
        F.try_divide(F.col("events"), F.col("expected")).alias("deviation_ratio"),
    )


def error_rate_spikes(
    df: DataFrame, is_error: Column, ts: str = "ts", seconds: int = 300, min_buckets: int = 3, deviations: float = 2
) -> DataFrame:
    """Buckets whose error share exceeds median + 2 standard deviations of all shares."""
    rates = (
        df.where(F.col(ts).isNotNull())
        .groupBy(time_bucket(F.col(ts), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error).alias("errors"))
        .withColumn("error_rate", F.col("errors") / F.col("total"))
    )
    baseline = rates.agg(
        F.median("error_rate").alias("baseline_rate"),
        F.stddev_samp("error_rate").alias("_sd"),
        F.count(F.lit(1)).alias("_buckets"),
    )
    return (
        with_scalars(rates, baseline)
        .where((F.col("_buckets") >= min_buckets) & (F.col("error_rate") > F.col("baseline_rate") + deviations * F.col("_sd")))
        .select(
            "bucket",
            "total",
            "errors",
            "error_rate",
            "baseline_rate",
            F.when(F.col("error_rate") > 0.5, "high").otherwise("medium").alias("severity"),
        )
    )


def activity_spikes(df: DataFrame, ts: str = "ts", seconds: int = 3600, deviations: float = 2.5) -> DataFrame:
    counts = (
        df.where(F.col(ts).isNotNull())
        .groupBy(time_bucket(F.col(ts), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    baseline = counts.agg(F.avg("events").alias("mean_events"), F.stddev_samp("events").alias("sd_events"))
    return (
        with_scalars(counts, baseline)
        .where((F.col("sd_events") > 0) & (F.col("events") > F.col("mean_events") + deviations * F.col("sd_events")))
        .withColumn(
            "confidence", F.least((F.col("events") - F.col("mean_events")) / (F.col("sd_events") + 1), F.lit(1.0))
        )
    )


def error_ratio(df: DataFrame, is_error: Column, min_rows: int = 100, over: float = 0.2) -> DataFrame:
    share = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error).alias("errors"))
    rate = F.col("errors") / F.col("total")
    return share.where((F.col("total") > min_rows) & (rate > over)).select(
        "total", "errors", rate.alias("error_rate"), F.least(rate * 2, F.lit(0.95)).alias("confidence")
    )


def temporal_clusters(
    df: DataFrame,
    event_type: str = "event_type",
    source: str = "source",
    ts: str = "ts",
    seconds: int = 300,
    over_events: int = 10,
    min_types: int = 4,
    min_sources: int = 3,
) -> DataFrame:
    """Three consecutive non-empty buckets with many events, types and sources.

    Distinct values of a bucket group are counted from (bucket, value) rows given to the
    groups they belong to, so no set of sources is ever held in a buffer.
    """
    base = df.where(F.col(ts).isNotNull()).withColumn("bucket", time_bucket(F.col(ts), seconds))
    sizes = base.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    # the number of buckets is bounded by time covered / bucket width
    order = W.orderBy("bucket")
    groups = sizes.select(
        F.col("bucket").alias("start"),
        F.lead("bucket", 1).over(order).alias("_b1"),
        F.lead("bucket", 2).over(order).alias("_b2"),
        (F.col("_n") + F.lead("_n", 1).over(order) + F.lead("_n", 2).over(order)).alias("events"),
    ).where(F.col("_b2").isNotNull() & (F.col("events") > over_events))
    members = groups.select("start", "events", F.col("_b2").alias("end"), F.explode(F.array("start", "_b1", "_b2")).alias("bucket"))
    kinds = base.select("bucket", F.lit("type").alias("_what"), F.col(event_type).cast("string").alias("_value")).union(
        base.select("bucket", F.lit("source"), F.col(source).cast("string"))
    ).where(F.col("_value").isNotNull()).distinct()
    tallied = (
        kinds.join(members, "bucket")
        .select("start", "end", "events", "_what", "_value")
        .distinct()
        .groupBy("start", "end", "events")
        .agg(
            F.count_if(F.col("_what") == "type").alias("types"),
            F.count_if(F.col("_what") == "source").alias("sources"),
        )
    )
    return tallied.where((F.col("types") >= min_types) & (F.col("sources") >= min_sources))


def type_correlation(
    df: DataFrame,
    event_type: str = "event_type",
    ts: str = "ts",
    min_events: int = 5,
    above: float = 0.7,
    max_bins: int | None = None,
    bin_seconds: int = 60,
) -> DataFrame:
    """Pearson correlation of the per-minute counts of each pair of event types.

    The bins of a pair start at its first event and reach to its last one, ten at least.
    With `max_bins` a pair sees only its first `max_bins` minutes. Types are
    counted per microsecond-aligned bin offset of each pair start, which is one of the
    two type starts; all sums of the correlation come from those counts.
    """
    base = df.where(F.col(ts).isNotNull() & F.col(event_type).isNotNull()).select(
        F.col(event_type).alias("t"), micros(ts).alias("us")
    )
    spans = (
        base.groupBy("t")
        .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_events)
    )
    left = spans.select(*[F.col(c).alias(f"a_{c}") for c in spans.columns])
    right = spans.select(*[F.col(c).alias(f"b_{c}") for c in spans.columns])
    # pairs of event types: the catalogue of types, not the events
    width = bin_seconds * 1_000_000
    pairs = left.join(right, F.col("a_t") < F.col("b_t")).withColumn("start", F.least("a_first", "b_first"))
    bins = F.greatest(F.lit(10), F.floor((F.greatest("a_last", "b_last") - F.col("start")) / F.lit(width)))
    bins = F.least(bins, F.lit(max_bins)) if max_bins is not None else bins + 1
    pairs = pairs.withColumn("bins", bins.cast("long"))
    starts = pairs.select(F.explode(F.array("a_t", "b_t")).alias("t"), "start").distinct()
    counted = (
        base.join(starts, "t")
        .withColumn("bin", F.floor((F.col("us") - F.col("start")) / F.lit(width)))
        .where(F.col("bin") >= 0)
        .groupBy("t", "start", "bin")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    one = pairs.select("a_t", "b_t", "start", "bins")
    both = one.join(counted.withColumnRenamed("t", "a_t").withColumnRenamed("c", "x"), ["a_t", "start"]).select(
        "a_t", "b_t", "start", "bins", "bin", "x", F.lit(0.0).alias("y")
    ).union(
        one.join(counted.withColumnRenamed("t", "b_t").withColumnRenamed("c", "y"), ["b_t", "start"]).select(
            "a_t", "b_t", "start", "bins", "bin", F.lit(0.0), "y"
        )
    )
    merged = both.where(F.col("bin") < F.col("bins")).groupBy("a_t", "b_t", "bins", "bin").agg(
        F.sum("x").alias("x"), F.sum("y").alias("y")
    )
    sums = merged.groupBy("a_t", "b_t", "bins").agg(
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )
    n = F.col("bins")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    return (
        sums.select(F.col("a_t").alias("type_a"), F.col("b_t").alias("type_b"), F.greatest(r, F.lit(0.0)).alias("correlation"))
        .where(F.col("correlation") > above)
    )
