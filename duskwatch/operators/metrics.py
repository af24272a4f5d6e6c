"""Counters, histograms, quantiles, rates and fleet tiles."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default latency bucket bounds in seconds.
LATENCY_BOUNDS = (1e-6, 5e-6, 1e-5, 5e-5, 1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2, 0.1)


def counter(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bounds=LATENCY_BOUNDS, label: str | None = None) -> DataFrame:
    """(label, le, count, total, sum): cumulative buckets in one aggregation."""
    bounds = sorted(bounds)
    key = F.lit("") if label is None else F.col(label)
    v = F.col(value)
    one = df.filter(v.isNotNull()).groupBy(key.alias("label")).agg(
        *[F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("total"), F.sum(v).alias("sum"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("count")))
    return one.select("label", F.explode(F.array(*rows)).alias("b"), "total", "sum") \
        .select("label", "b.le", "b.count", "total", "sum")


def bucket_quantile(hist: DataFrame, q: float) -> DataFrame:
    """(label, quantile) by linear interpolation inside the bucket that holds rank q*total.

    The window is over the few buckets of a label, never over observations.
    """
    w = Window.partitionBy("label").orderBy("le")
    placed = (hist.withColumns({
        "lower": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
        "below": F.coalesce(F.lag("count").over(w), F.lit(0))})
        .filter((F.col("total") > 0) & (F.col("count") >= F.col("total") * q)))
    first = placed.groupBy("label").agg(
        F.min_by(F.struct("le", "count", "total", "lower", "below"), "le").alias("b"))
    b = lambda n: F.col(f"b.{n}")
    inside = b("lower") + (b("le") - b("lower")) * (b("total") * q - b("below")) / (b("count") - b("below"))
    value = (F.when(b("le") == float("inf"), b("lower"))
             .when((b("lower") == 0.0) & (b("le") <= 0), b("le")).otherwise(inside))
    return first.select("label", value.alias("quantile"))


def rate(df: DataFrame, width: timedelta, slide: timedelta | None = None, ts: str = "ts") -> DataFrame:
    """(start, n, per_second) per tumbling or sliding window."""
    seconds = width.total_seconds()
    text = lambda d: f"{int(d / timedelta(microseconds=1))} microseconds"
    window = F.window(ts, text(width)) if slide is None else F.window(ts, text(width), text(slide))
    return (df.groupBy(window.alias("w")).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), "n", (F.col("n") / F.lit(seconds)).alias("per_second")))


def fleet_summary(agents: DataFrame, now: datetime, ttl: timedelta) -> DataFrame:
    """One row: agents, how many reported within ``ttl``, and their counters summed."""
    online = F.col("last_seen") >= F.lit(now - ttl)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return agents.agg(F.count("*").alias("agents"), F.count_if(online).alias("online"),
                      total("events_processed"), total("alerts"), total("incidents"))
