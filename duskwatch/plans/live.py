"""Registered queries of the live path and of sources and sinks: the given tables, replayed or written and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, export, investigate
from ..operators.detect import detect
from ..schema import micros
from ..session import Shelf
from ..sources import events, lake, sinks
from ..streaming import live, stateful
from ..streaming.replay import even_slices, replay, time_slices, to_parquet
from . import samples as S
from .queries import DAY, T0, TRAINED, Query
from .telemetry import telemetry

REGISTRY: dict[str, Query] = {}
SLICES = 3
ARRIVALS = 4
RULES_BEFORE = [r for r in S.RULES if r["id"] < "R-0030"]
RULES_AFTER = [r for r in S.RULES if r["id"] >= "R-0020"]
SINKS = ("first", "second")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _streamed(df: DataFrame, slices, operator, folder: str) -> DataFrame:
    """What a streaming operator puts out over a replay of ``df``, read from its sink."""
    schema = []

    def start(source: DataFrame):
        out = operator(source)
        schema[:] = [out.schema]
        return to_parquet(out, folder)

    replay(df, slices, folder, start)
    return df.sparkSession.read.schema(schema[0]).parquet(f"{folder}/sink")


def _written_records(shelf: Shelf, t: DataFrame) -> DataFrame:
    return shelf.save(export.flatten_alerts(detect(t, S.RULES)), "records")


@query
def streamed_incidents(spark, d):
    """The month in time order, state handed on through the checkpoint between slices."""
    stateful.use_rocksdb(spark)
    shelf = Shelf(spark)
    t = shelf.save(telemetry(spark, d), "events")
    out = _streamed(t, time_slices(t, SLICES), lambda s: stateful.stream_incidents(s, S.RULES, DAY), shelf.folder)
    return out.select("host", "process_key", "seq", "risk_score", "first_us", F.col("us").alias("last_us"),
                      F.array_join("techniques", ",").alias("techniques"), F.array_join("rule_ids", ",").alias("rule_ids"))


@query
def streamed_signals(spark, d):
    """Fleet signals from the alert stream."""
    stateful.use_rocksdb(spark)
    shelf = Shelf(spark)
    records = _written_records(shelf, telemetry(spark, d))
    out = _streamed(records, time_slices(records, SLICES, "time"),
                    lambda s: stateful.stream_signals(s, timedelta(hours=6), 3), shelf.folder)
    return out.select("kind", "key", F.array_join("hosts", ",").alias("hosts"), "first_us", "last_us")


@query
def streamed_process_tree(spark, d):
    """Parent and ancestry of each event as it arrives; what no event names for sixty days is forgotten."""
    stateful.use_rocksdb(spark)
    shelf = Shelf(spark)
    t = shelf.save(telemetry(spark, d), "events")
    out = _streamed(t, time_slices(t, SLICES), lambda s: stateful.stream_process_tree(s, keep=timedelta(days=60)), shelf.folder)
    return out.select("seq", "parent_name", "parent_executable", "start_time_ns",
                      F.coalesce(F.array_join("ancestors", ">"), F.lit("")).alias("chain"))


def _arrivals(t: DataFrame):
    """Arrival slices by number of event; every seventeenth event comes a slice later."""
    number = even_slices(t, F.col("seq"), ARRIVALS)
    return F.least(number + F.when(F.col("seq") % 17 == 0, 1).otherwise(0), F.lit(ARRIVALS - 1)).cast("int")


@query
def late_split(spark, d):
    """On-time and late events together are the input; late is over a day behind the slices before."""
    shelf = Shelf(spark)
    t = shelf.save(telemetry(spark, d).select("seq", "ts", "host"), "events")
    rows = f"{shelf.folder}/rows"

    def into(late: bool):
        return lambda part: part.withColumn("late", F.lit(late)).write.mode("append").parquet(rows)

    replay(t, _arrivals(t), shelf.folder,
           lambda s: live.split_late(s, DAY, into(False), into(True), f"{shelf.folder}/checkpoint"))
    schema = t.withColumn("late", F.lit(True)).schema
    return spark.read.schema(schema).parquet(rows).select("seq", "host", "late")


@query
def append_replays(spark, d):
    """Every third event comes again a slice later; each is appended once."""
    shelf = Shelf(spark)
    t = shelf.save(telemetry(spark, d).select("seq", "ts", "host", "action"), "events")
    numbered = t.withColumn("slice", time_slices(t, SLICES))
    again = numbered.filter("seq % 3 = 0").withColumn("slice", F.least(F.col("slice") + 1, F.lit(SLICES - 1)))
    feed = shelf.save(numbered.unionByName(again), "feed")
    out = _streamed(feed, F.col("slice"), live.append_once, shelf.folder)
    return out.select("seq", "host", "action", micros().alias("us"))


@query
def rule_swap(spark, d):
    """One running detection, other rules from the second slice on."""
    shelf = Shelf(spark)
    t = shelf.save(telemetry(spark, d), "events")
    current = []

    def swap(number: int) -> None:
        current[:] = [RULES_BEFORE if number == 0 else RULES_AFTER]

    out, schema = f"{shelf.folder}/alerts", export.flatten_alerts(detect(t, S.RULES)).schema
    replay(t, even_slices(t, F.col("seq"), SLICES), shelf.folder,
           lambda s: live.detect_stream(s, lambda: current[0], [lambda b: b.write.mode("append").parquet(out)], f"{shelf.folder}/checkpoint"),
           swap)
    return spark.read.schema(schema).parquet(out).select("seq", "rule_id", F.col("hostname").alias("host"))


@query
def replayed_alerts(spark, d):
    """Events recorded as NDJSON, streamed back from the files and run through detection."""
    shelf = Shelf(spark)
    sinks.write_ndjson(events.recorded(telemetry(spark, d)), f"{shelf.folder}/recorded")
    source = events.stream_events(spark, f"{shelf.folder}/recorded")
    live.run_available(to_parquet(export.flatten_alerts(detect(source, S.RULES)), shelf.folder))
    schema = export.flatten_alerts(detect(telemetry(spark, d), S.RULES)).schema
    out = spark.read.schema(schema).parquet(f"{shelf.folder}/sink")
    return out.select("id", "rule_id", F.col("hostname").alias("host"), F.col("risk_score").cast("long").alias("risk_score"))


@query
def recorded_events(spark, d):
    """Events written as NDJSON and read back."""
    path = f"{Shelf(spark).folder}/recorded"
    sinks.write_ndjson(events.recorded(telemetry(spark, d)), path)
    return events.read_events(spark, path).select(
        micros().alias("us"), "host", "action", "process.pid", "process.command_line", F.col("user.name").alias("user_name"),
        "network.domain", "file.path", "network.dst_port", "process.stdio_socket")


@query
def lake_retained(spark, d):
    """A2, A3, A5: events appended to the lake in two batches, pruned, and read in the lake's own layout."""
    path, t = f"{Shelf(spark).folder}/lake", telemetry(spark, d)
    for half in (0, 1):
        lake.write_lake(t.filter(F.col("seq") % 2 == half), path)
    lake.prune_lake(spark, path, T0)
    return lake.lake_query(lake.read_lake(spark, path), ascending=True).select("seq", "host", "action", micros().alias("us"))


@query
def fan_out_sinks(spark, d):
    """Alerts in two sinks, though a third always fails."""
    shelf = Shelf(spark)
    records = _written_records(shelf, telemetry(spark, d))

    def sink(name: str):
        return lambda b: b.withColumn("sink", F.lit(name)).write.mode("append").parquet(f"{shelf.folder}/fan")

    def broken(batch: DataFrame) -> None:
        raise OSError("sink is down")

    try:
        sinks.fan_out(records, [sink(SINKS[0]), broken, sink(SINKS[1])])
    except ExceptionGroup as failed:
        if [type(e) for e in failed.exceptions] != [OSError]:
            raise
    schema = records.withColumn("sink", F.lit("")).schema
    return spark.read.schema(schema).parquet(f"{shelf.folder}/fan").select("sink", "seq", "rule_id")


@query
def alert_found(spark, d):
    """The alert with the smallest id, asked for by it."""
    records = _written_records(Shelf(spark), telemetry(spark, d))
    wanted = records.agg(F.min("id")).first()[0]
    return investigate.alert_by_id(records, wanted or "").select("id", "seq", "rule_id", F.col("hostname").alias("host"))


@query
def saved_model_scores(spark, d):
    """baseline and forest saved, loaded again, the baseline scored on the whole month."""
    t, path = telemetry(spark, d), f"{Shelf(spark).folder}/model"
    training = t.filter(F.col("ts") < F.lit(TRAINED))
    anomaly.save_model(anomaly.build_baseline(training), anomaly.fit_iforest(training), path)
    baseline, _ = anomaly.load_model(spark, path)
    return anomaly.score_rarity(t, baseline).select("seq", F.round("rarity", 6).alias("rarity"))
