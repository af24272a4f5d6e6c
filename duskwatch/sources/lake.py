"""The event lake: Parquet partitioned by date and action, sorted by host and time."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import search_text
from ..operators.ordered import newest_first, oldest_first


def with_lake_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"event_date": F.to_date("ts"), "search": search_text()})


def write_lake(df: DataFrame, path: str, mode: str = "append", files_per_slice: int = 16) -> None:
    """Append events.  A (date, action) slice is spread over hosts and files, so one busy
    action or host does not become one writer task; rows sort by host and time for min/max pruning."""
    rows = with_lake_columns(df)
    spread = F.pmod(F.xxhash64("host", "seq"), F.lit(files_per_slice))
    (rows.repartition("event_date", "action", spread)
     .sortWithinPartitions("event_date", "action", "host", "ts")
     .write.mode(mode).partitionBy("event_date", "action").parquet(path))


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lake_query(df: DataFrame, action: str = "", host: str = "", pid: int = 0, since: datetime | None = None,
               until: datetime | None = None, contains: str = "", limit: int | None = None,
               ascending: bool = False) -> DataFrame:
    """Filter and order events; bounds are inclusive, ``contains`` is literal and case-insensitive.

    All matches, unless a positive ``limit`` asks for a page.
    """
    dated = "event_date" in df.columns
    if action:
        df = df.filter(F.col("action") == action)
    if host:
        df = df.filter(F.col("host") == host)
    if pid:
        df = df.filter(F.col("process.pid") == pid)
    if since is not None:
        df = df.filter(F.col("ts") >= F.lit(since))
        df = df.filter(F.col("event_date") >= F.to_date(F.lit(since))) if dated else df
    if until is not None:
        df = df.filter(F.col("ts") <= F.lit(until))
        df = df.filter(F.col("event_date") <= F.to_date(F.lit(until))) if dated else df
    if contains:
        text = F.col("search") if "search" in df.columns else search_text()
        df = df.filter(text.contains(contains.lower()))
    order = oldest_first if ascending else newest_first
    return order(df, limit if limit and limit > 0 else None)


def expired(before: datetime, column: str = "ts") -> Column:
    """Rows strictly before the cutoff go; ``column`` is ``time`` for alert records."""
    return F.coalesce(F.col(column) < F.lit(before), F.lit(False))


def prune(df: DataFrame, before: datetime, column: str = "ts") -> DataFrame:
    """The rows that retention keeps."""
    return df.filter(~expired(before, column))


def retention_report(df: DataFrame, before: datetime, column: str = "ts") -> DataFrame:
    """One row, from one pass: how many rows are ``kept`` and ``pruned``, and the ``first_seq`` kept."""
    old = expired(before, column)
    return df.agg(F.count_if(~old).alias("kept"), F.min(F.when(~old, F.col("seq"))).alias("first_seq"), F.count_if(old).alias("pruned"))


def prune_lake(spark: SparkSession, path: str, before: datetime) -> int:
    """Apply retention to a lake folder; returns the number of rows removed.

    Whole dates before the cutoff are dropped as folders; only the boundary date is rewritten,
    through dynamic partition overwrite from a staged copy of its own. A run that dies can be
    repeated: what is left is pruned again.
    """
    lake = read_lake(spark, path)
    old = F.col("ts") < F.lit(before)
    touched = lake.filter(F.col("event_date") <= F.to_date(F.lit(before)))
    counts = touched.groupBy("event_date", "action").agg(
        F.count_if(old).alias("gone"), F.count("*").alias("total")).filter("gone > 0")
    # One row per (date, action) slice of the lake: partition metadata, not data.
    slices = counts.collect()
    boundary = [r for r in slices if r["gone"] < r["total"]]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if boundary:
        keep = lake.filter((F.col("event_date") == F.to_date(F.lit(before))) & ~old)
        staged = f"{path.rstrip('/')}_boundary_{uuid.uuid4().hex}"
        keep.write.mode("overwrite").partitionBy("event_date", "action").parquet(staged)
        (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_date", "action").parquet(path))
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    for row in slices:
        if row["gone"] == row["total"]:
            folder = f"{path.rstrip('/')}/event_date={row['event_date']}/action={row['action']}"
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    spark.catalog.refreshByPath(path)
    return sum(r["gone"] for r in slices)
