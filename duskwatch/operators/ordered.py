"""Ordered scans over keys of any size.

A plain window puts a whole key into one task.  These scans cut a key's timeline into
buckets, scan each bucket on its own, and pass between buckets only one small summary
row per (key, bucket).  Results equal those of the plain window.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import micros

BUCKET = timedelta(hours=6)


def width_us(width: timedelta) -> int:
    return int(width / timedelta(microseconds=1))


def time_bucket(width: timedelta, ts: str | Column = "ts") -> Column:
    return F.floor(micros(ts) / F.lit(width_us(width)))


def nearest(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column,
            forward: bool = False, inclusive: bool = False) -> DataFrame:
    """Add the closest non-null ``value`` before (or ``forward``: after) each row of its key.

    ``bucket`` must be non-decreasing in ``order`` within a key.  One shuffle moves the
    rows; one pre-aggregated summary row per (key, bucket) supplies what a bucket
    inherits from its neighbours.
    """
    if forward:
        sort = [F.col(c).desc() for c in order]
        bucket_order, pick = F.col("_b").desc(), F.min_by
    else:
        sort = [F.col(c).asc() for c in order]
        bucket_order, pick = F.col("_b").asc(), F.max_by
    rows = df.withColumns({"_b": bucket, "_v": value})
    frame = (Window.partitionBy(*keys, "_b").orderBy(*sort)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = rows.withColumn("_local", F.last("_v", ignorenulls=True).over(frame))
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    summary = rows.groupBy(*keys, "_b").agg(pick("_v", place).alias("_edge"))
    earlier = (Window.partitionBy(*keys).orderBy(bucket_order)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(*keys, "_b", F.last("_edge", ignorenulls=True).over(earlier).alias("_carry"))
    return (local.join(carry, [*keys, "_b"], "left")
            .withColumn(out, F.coalesce("_local", "_carry"))
            .drop("_b", "_v", "_local", "_carry"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation keeps one row per key and task."""
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
            .select("_row.*"))


def newest_first(df: DataFrame, limit: int | None = None, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Newest first, ties by arrival; with a limit this is a distributed top-k."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(seq).desc())
    return ordered if limit is None else ordered.limit(limit)


def oldest_first(df: DataFrame, limit: int | None = None, ts: str = "ts", seq: str = "seq") -> DataFrame:
    ordered = df.orderBy(F.col(ts).asc(), F.col(seq).asc())
    return ordered if limit is None else ordered.limit(limit)


def recent_history(df: DataFrame, keep: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest ``keep`` rows, oldest of them first."""
    return oldest_first(newest_first(df, keep, ts, seq), None, ts, seq)


def number_rows(df: DataFrame, order: list[str], bucket: Column, out: str = "number") -> DataFrame:
    """Global 1-based row numbers: numbered per bucket, offset by the counts before it.

    ``bucket`` must be non-decreasing in ``order``.  Only the per-bucket counts (one row
    per bucket) meet in a single window.
    """
    rows = df.withColumn("_b", bucket)
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_b").count()
               .select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")))
    return local.join(offsets, "_b").withColumn(out, F.col("_n") + F.col("_offset")).drop("_b", "_n", "_offset")
