"""Replays of a recorded table through a streaming query, slice by slice from one checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schema import micros
from .live import run_available

SLICE = "_slice"


def even_slices(df: DataFrame, place: Column, count: int) -> Column:
    """Slice numbers 0 to ``count`` - 1 of equal width over the range of the long ``place``."""
    low, high = df.agg(F.min(place), F.max(place)).first()
    if low is None:
        return F.lit(0)
    number = F.floor((place - low) * count / F.lit(high - low + 1))
    return F.least(number, F.lit(count - 1)).cast("int")


def time_slices(df: DataFrame, count: int, ts: str = "ts") -> Column:
    return even_slices(df, micros(ts), count)


def replay(df: DataFrame, slices: Column, folder: str, start: Callable[[DataFrame], DataStreamWriter],
           before: Callable[[int], None] | None = None) -> None:
    """Stream ``df`` through the query that ``start`` builds on its source.

    The table is written once, by slice. Then slice after slice moves into the source folder and
    the query runs over what is now available and stops, so a slice may hold any number of files
    and every hand-over of state goes through the checkpoint. ``before`` is told each slice number
    before its run. ``start`` must name the same checkpoint each time. Rows of a null slice come
    first, an empty table is one run without rows.
    """
    spark = df.sparkSession
    staged, source = f"{folder}/staged", f"{folder}/source"
    (df.withColumn(SLICE, F.coalesce(slices, F.lit(0))).write.partitionBy(SLICE).parquet(staged))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(source))
    # One name per slice: metadata of the replay, not data.
    numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(staged))
                     if s.getPath().getName().startswith(f"{SLICE}="))
    for number in numbers or [None]:
        if number is not None:
            fs.rename(path(f"{staged}/{SLICE}={number}"), path(f"{source}/part-{number}"))
        if before:
            before(number or 0)
        run_available(start(_source(spark, df, source)))


def _source(spark: SparkSession, df: DataFrame, source: str) -> DataFrame:
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(source)


def to_parquet(out: DataFrame, folder: str) -> DataStreamWriter:
    """An exactly-once Parquet sink with its checkpoint beside it."""
    return (out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/sink")
            .option("checkpointLocation", f"{folder}/checkpoint"))
