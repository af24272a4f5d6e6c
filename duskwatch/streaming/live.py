"""Live detection, alert tail, rates with watermarks, idempotent append, replay."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.detect import detect
from ..operators.export import flatten_alerts
from ..operators.ordered import width_us
from ..schema import micros
from ..sources.sinks import fan_out


def detect_stream(events: DataFrame, rules_provider: Callable[[], list[dict]],
                  sinks: list[Callable[[DataFrame], None]], checkpoint: str) -> DataStreamWriter:
    """Alerts per micro-batch under the rules current at its start; a swap never splits a batch."""
    def run(batch: DataFrame, _: int) -> None:
        fan_out(flatten_alerts(detect(batch, rules_provider())), sinks)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def tail_alerts(records: DataFrame, host: str = "", severity: str = "", technique: str = "",
                incidents_only: bool = False) -> DataFrame:
    """Filter of the live alert feed (stream or batch)."""
    if host:
        records = records.filter(F.col("hostname") == host.strip())
    if severity:
        records = records.filter(F.lower("severity") == severity.lower())
    if technique:
        records = records.filter(F.col("technique_id") == technique.strip())
    return records.filter("is_incident") if incidents_only else records


def rate_stream(df: DataFrame, width: timedelta, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events per tumbling window once the watermark closes it; later rows are dropped."""
    span = f"{int(width / timedelta(microseconds=1))} microseconds"
    return (df.withWatermark(ts, delay).groupBy(F.window(ts, span).alias("w")).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), "n", (F.col("n") / width.total_seconds()).alias("per_second")))


def late_rows(batch: DataFrame, watermark_us: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(on time, late) split of a batch against a watermark, for a late-row side output."""
    late = F.coalesce(F.unix_micros(ts) < watermark_us, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def split_late(events: DataFrame, delay: timedelta, on_time: Callable[[DataFrame], None],
               late: Callable[[DataFrame], None], checkpoint: str, ts: str = "ts") -> DataStreamWriter:
    """Rows behind the watermark to ``late``, all others (without a time, too) to ``on_time``.

    The watermark of a batch is the newest time of the batches before it, less ``delay``. It is kept
    beside the checkpoint as one row per batch, so a batch that runs again after a failure splits as
    before; a batch whose predecessor left no mark fails rather than guess.
    """
    marks, late_us = f"{checkpoint.rstrip('/')}-marks", width_us(delay)

    def run(batch: DataFrame, number: int) -> None:
        spark, held = batch.sparkSession, batch.persist()
        try:
            before = spark.read.parquet(f"{marks}/{number - 1}").first()["newest_us"] if number else None
            newest = held.agg(F.max(micros(ts))).first()[0]
            fresh, behind = late_rows(held, before - late_us, ts) if before is not None else (held, held.limit(0))
            on_time(fresh)
            late(behind)
            seen = [us for us in (before, newest) if us is not None]
            mark = spark.range(1).select(F.lit(max(seen) if seen else None).cast("long").alias("newest_us"))
            mark.write.mode("overwrite").parquet(f"{marks}/{number}")
        finally:
            held.unpersist()
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def append_once(df: DataFrame, key: str = "seq", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Drop replays of an event within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything now available, then stop: a replay."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
