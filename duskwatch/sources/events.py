"""Recorded events: NDJSON in, normalized event frame out, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, EVENT_JSON, conform, normalize


def _shape(raw: DataFrame, seq) -> DataFrame:
    df = raw.withColumns({"seq": seq, "event_type": F.lit(None).cast("int")}).withColumnRenamed("@timestamp", "ts")
    return normalize(df.select(*EVENT.fieldNames()))


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Batch read.  ``seq`` follows line order within a file split and breaks timestamp ties."""
    raw = spark.read.schema(EVENT_JSON).option("mode", "FAILFAST").json(path)
    return _shape(raw, F.monotonically_increasing_id())


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same schema as a stream of files; ``seq`` is a stable number of file and line content."""
    raw = (spark.readStream.schema(EVENT_JSON).option("mode", "FAILFAST")
           .option("maxFilesPerTrigger", files_per_trigger).json(path))
    return _shape(raw, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))))


def recorded(df: DataFrame) -> DataFrame:
    """Events in the recorded form: written as NDJSON, ``read_events`` reads them back whole."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("@timestamp")
    return df.select(stamp, *[f.name for f in EVENT_JSON.fields[1:]])


def event_frame(df: DataFrame) -> DataFrame:
    """Any partial event frame completed to the schema and normalized."""
    return normalize(conform(df))
