"""Writers: NDJSON, the record store, idempotent alert append, multi-sink fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str, max_records: int = 1_000_000, mode: str = "append") -> None:
    """One JSON document per line, absent members omitted, files rotated by record count."""
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "seq"]))
    df.select(document.alias("value")).write.mode(mode).option("maxRecordsPerFile", max_records).text(path)


def records(df: DataFrame, kind: str) -> DataFrame:
    """(kind, ts, doc) rows of ECS documents."""
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "seq"]))
    return df.select(F.lit(kind).alias("kind"), F.col("`@timestamp`").alias("ts"), document.alias("doc"))


def write_records(df: DataFrame, kind: str, path: str) -> None:
    records(df, kind).write.mode("append").partitionBy("kind").parquet(path)


def append_alerts(flat: DataFrame, path: str) -> None:
    """Append fleet records by date; ids are content-derived, so readers can drop replays by id."""
    flat.withColumn("alert_date", F.to_date("time")).write.mode("append").partitionBy("alert_date").parquet(path)


def fan_out(batch: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Give one batch to every sink; a failing sink does not stop the rest, errors are joined."""
    cached, errors = batch.persist(), []
    try:
        for sink in sinks:
            try:
                sink(cached)
            except Exception as error:  # noqa: BLE001 - every sink must be tried
                errors.append(error)
    finally:
        cached.unpersist()
    if errors:
        raise ExceptionGroup("sink failures", errors)
