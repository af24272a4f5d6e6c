"""Incidents per process and signals across the fleet."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import process_key
from ..schema import micros
from ..session import materialize
from .detect import alert_risk
from .ordered import BUCKET, width_us
from .rule_index import collected

WINDOW, THRESHOLD = timedelta(seconds=30), 75
SIGNAL_WINDOW, MIN_HOSTS = timedelta(minutes=5), 3


def risk_events(alerts: DataFrame) -> DataFrame:
    """Alerts folded to event grain: one row per event that raised any alert.

    The alerts of one event count together before the threshold is tested; their number
    is bounded by the rule table.
    """
    fired = F.struct(F.col("rule.ord").alias("ord"), F.col("rule.id").alias("rule_id"),
                     F.col("rule.technique.id").alias("technique_id"))
    return (alerts.groupBy(F.coalesce("host", F.lit("")).alias("host"), process_key().alias("process_key"),
                           micros("ts").alias("us"), "seq")
            .agg(F.sum(alert_risk()).cast("long").alias("risk"),
                 F.max("process.name").alias("name"), F.max("process.pid").alias("pid"),
                 F.array_sort(F.collect_list(fired)).alias("fired")))


def fired_events(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``risk_events`` of the rule alerts of ``df`` without forming alert rows: no shuffle.

    Also works on a stream.
    """
    if not rules:
        none = {"id": "", "severity": "low", "risk_score": 0, "technique": {"id": ""}, "match": {"field": "event.type", "op": "exists"}}
        return fired_events(df.filter(F.lit(False)), [none])
    default = {"low": 10, "medium": 25, "high": 50, "critical": 80}
    facts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r["id"]).alias("rule_id"),
                               F.lit(r["technique"]["id"]).alias("technique_id"),
                               F.lit(r["risk_score"] or default[r["severity"]]).alias("risk"))
                      for i, r in enumerate(rules)])
    hit = collected(df, rules)
    full = F.transform("_hits", lambda i: F.get(facts, i))
    return hit.select(
        F.coalesce("host", F.lit("")).alias("host"), process_key().alias("process_key"), "ts",
        micros("ts").alias("us"), "seq",
        F.aggregate(full, F.lit(0).cast("long"), lambda acc, f: acc + f["risk"]).alias("risk"),
        F.col("process.name").alias("name"), F.col("process.pid").alias("pid"),
        F.transform(full, lambda f: F.struct(f["ord"].alias("ord"), f["rule_id"].alias("rule_id"),
                                             f["technique_id"].alias("technique_id"))).alias("fired"))


def sessions(events: DataFrame, keys: list[str], window: timedelta, bucket: timedelta = BUCKET) -> DataFrame:
    """Gap sessions with a running risk: adds ``session`` (start micros) and ``run``.

    A session ends when the next event comes more than ``window`` later.  A key's events
    are scanned per time bucket; the open session handed from bucket to bucket is worked
    out on one summary row per (key, bucket).
    """
    gap = width_us(window)
    rows = events.withColumn("_b", F.floor(F.col("us") / width_us(bucket)))
    in_order = Window.partitionBy(*keys, "_b").orderBy("us", "seq")
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("us").over(in_order)
    rows = rows.withColumn("_cut", F.when(F.col("us") - previous > gap, 1).otherwise(0))
    rows = rows.withColumn("_seg", F.sum("_cut").over(running))
    in_segment = (Window.partitionBy(*keys, "_b", "_seg").orderBy("us", "seq")
                  .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_run": F.sum("risk").over(in_segment), "_start": F.min("us").over(in_segment)})

    piece = F.struct(F.col("_start").alias("start"), F.col("us").alias("end"), F.col("_run").alias("run"))
    place = F.struct("us", "seq")
    # The last row of the first and of the last segment of each bucket.
    summary = rows.groupBy(*keys, "_b").agg(
        F.max_by(piece, F.when(F.col("_seg") == 0, place)).alias("head"),
        F.max_by(piece, place).alias("tail"), F.max("_seg").alias("cuts"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    summary = summary.withColumn("joins", F.coalesce(
        F.col("head.start") - F.lag("tail.end").over(by_bucket) <= gap, F.lit(False)))
    summary = summary.withColumn("_chain", F.sum(F.when(F.col("joins") & (F.col("cuts") == 0), 0).otherwise(1))
                                 .over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    in_chain = (Window.partitionBy(*keys, "_chain").orderBy("_b")
                .rowsBetween(Window.unboundedPreceding, 0))
    summary = summary.withColumns({"_open": F.min("tail.start").over(in_chain),
                                   "_sum": F.sum("tail.run").over(in_chain)})
    carry = summary.select(*keys, "_b", "joins", F.lag("_open").over(by_bucket).alias("_open"),
                           F.lag("_sum").over(by_bucket).alias("_sum"))
    continued = F.col("joins") & (F.col("_seg") == 0)
    return (rows.join(carry, [*keys, "_b"])
            .withColumns({"session": F.when(continued, F.col("_open")).otherwise(F.col("_start")),
                          "run": F.col("_run") + F.when(continued, F.col("_sum")).otherwise(0)})
            .drop("_b", "_cut", "_seg", "_run", "_start", "joins", "_open", "_sum"))


def correlate(alerts: DataFrame, window: timedelta = WINDOW, threshold: int = THRESHOLD,
              bucket: timedelta = BUCKET) -> DataFrame:
    """One incident per (host, process) session, as of the event that crosses the threshold."""
    return incidents_of(risk_events(alerts), window, threshold, bucket)


def incidents_of(events: DataFrame, window: timedelta = WINDOW, threshold: int = THRESHOLD,
                 bucket: timedelta = BUCKET) -> DataFrame:
    """Incidents from event-grain risk rows (``risk_events`` or ``fired_events``)."""
    keys = ["host", "process_key"]
    # The narrow risk rows are read twice below (scan and bucket summary): written once, so rules run once.
    events = sessions(materialize(events), keys, window, bucket)
    crossed = (F.col("run") >= threshold) & (F.col("run") - F.col("risk") < threshold)
    at = F.when(crossed, F.struct("us", "seq", "run", "name", "pid"))
    # First sighting of each rule in a session: at most one row per rule, so both
    # aggregations combine map-side and the collected list is bounded by the rule table.
    joined = (events.select(*keys, "session", "us", "seq", at.alias("at"), F.explode("fired").alias("f"))
              .groupBy(*keys, "session", F.col("f.rule_id").alias("rule_id"),
                       F.col("f.technique_id").alias("technique_id"))
              .agg(F.min(F.struct("us", "seq", F.col("f.ord").alias("ord"))).alias("seen"), F.min("at").alias("at"))
              .groupBy(*keys, "session")
              .agg(F.min("at").alias("at"),
                   F.array_sort(F.collect_list(F.struct("seen", "rule_id", "technique_id"))).alias("seen"))
              .filter("at is not null")
              .select(*keys, "session", "seen", "at", "at.run", "at.name", "at.pid"))
    upto = F.filter("seen", lambda s: F.struct(s["seen"]["us"], s["seen"]["seq"]) <= F.struct("at.us", "at.seq"))
    techniques = F.array_sort(F.array_distinct(F.filter(
        F.transform(upto, lambda s: s["technique_id"]), lambda t: F.coalesce(t, F.lit("")) != "")))
    out = joined.select(
        F.format_string("INC-%s-%d", "host", F.col("session") * 1000).alias("id"),
        "host", "process_key", F.col("run").alias("risk_score"),
        techniques.alias("techniques"),
        F.array_distinct(F.transform(upto, lambda s: s["rule_id"])).alias("rule_ids"),
        F.timestamp_micros("session").alias("first_seen"), F.timestamp_micros("at.us").alias("last_seen"),
        F.lit("open").alias("status"), "name", "pid", F.col("at.seq").alias("seq"))
    summary = F.format_string("process %s (pid %d) accumulated risk %d across %d techniques",
                              F.coalesce("name", F.lit("")), "pid", "risk_score", F.size("techniques"))
    return out.withColumn("summary", summary)


def sightings(records: DataFrame) -> DataFrame:
    """Alert records as (kind, key, host, us, seq): one per technique, one per destination."""
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    pairs = F.array(
        F.struct(F.lit("lateral-movement").alias("kind"), present("technique_id").alias("key")),
        F.struct(F.lit("c2-fanin").alias("kind"), present("destination_ip").alias("key")))
    return (records.select("hostname", "time", "seq", F.explode(pairs).alias("p"))
            .select("p.kind", "p.key", F.coalesce("hostname", F.lit("")).alias("host"),
                    micros("time").alias("us"), "seq")
            .filter("key is not null"))


def distinct_sightings(seen: DataFrame) -> DataFrame:
    """One row per distinct (key, host, instant): all that windows depend on."""
    return seen.groupBy("kind", "key", "host", "us").agg(F.min("seq").alias("seq"))


def anchored_windows(seen: DataFrame, window: timedelta, chunk: int = 16) -> DataFrame:
    """Add ``anchor``: start of the window each sighting falls in.

    A window opens at a key's first sighting and again at the first sighting more than
    ``window`` after the last opening: a recurrence along the key.  The timeline is cut
    into chunks of ``chunk`` windows.  Each chunk first tabulates, on its own, which
    opening it ends with for every possible incoming one (a monotone step function, few
    steps because the chains merge); composing those small tables along a key gives each
    chunk its true incoming opening, and the chunks then label their rows independently.
    """
    width = width_us(window)
    span = max(width, 1) * chunk
    rows = distinct_sightings(seen).withColumn("chunk", F.floor(F.col("us") / F.lit(span)))
    chunked = ["kind", "key", "chunk"]

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf["us"].drop_duplicates().sort_values().to_numpy()
        follow = times.searchsorted(times + width, side="right")
        final = times.copy()
        for i in range(len(times) - 1, -1, -1):
            if follow[i] < len(times):
                final[i] = final[follow[i]]
        # An incoming window ends at most one width into the chunk.
        start = int(pdf["chunk"].iloc[0]) * span
        reach = min(int(times.searchsorted(start + width, side="right")) + 1, len(times))
        last = [i for i in range(reach) if i == reach - 1 or final[i] != final[i + 1]]
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "key": pdf["key"].iloc[0],
                             "chunk": int(pdf["chunk"].iloc[0]),
                             "upto": times[last], "final": final[last]})

    steps = (rows.select(*chunked, "us").distinct().groupBy(*chunked)
             .applyInPandas(tabulate, "kind string, key string, chunk long, upto long, final long"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "upto"])
        opening, chunks, incoming = None, [], []
        for number, table in pdf.groupby("chunk", sort=True):
            chunks.append(number)
            incoming.append(opening)
            upto, final = table["upto"].to_numpy(), table["final"].to_numpy()
            at = 0 if opening is None else int(upto.searchsorted(opening + width, side="right"))
            if at < len(upto):
                opening = int(final[at])
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "key": pdf["key"].iloc[0], "chunk": chunks,
                             "incoming": pd.array(incoming, dtype="Int64")})

    incoming = steps.groupBy("kind", "key").applyInPandas(
        compose, "kind string, key string, chunk long, incoming long")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        us = pdf["us"].to_numpy()
        anchor = us.copy()
        first = pdf["incoming"].iloc[0]
        start = 0
        if not pd.isna(first):
            start = int(us.searchsorted(int(first) + width, side="right"))
            anchor[:start] = int(first)
        while start < len(us):
            end = int(us.searchsorted(us[start] + width, side="right"))
            anchor[start:end] = us[start]
            start = end
        return pdf.assign(anchor=anchor).drop(columns=["incoming", "chunk"])

    return (rows.join(incoming, chunked).groupBy(*chunked)
            .applyInPandas(label, "kind string, key string, host string, us long, seq long, anchor long"))


def fleet_signals(records: DataFrame, window: timedelta = SIGNAL_WINDOW, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """A signal each time a key reaches ``min_hosts`` distinct hosts in its anchored window."""
    # Read three times below: the reduced rows are written once instead of being recomputed.
    seen = materialize(distinct_sightings(sightings(records)))
    hosts = seen.groupBy("kind", "key", "host").agg(F.lit(1).alias("one"))
    # Keys that never reach the host count cannot fire; most keys end here.
    wide = hosts.groupBy("kind", "key").count().filter(F.col("count") >= min_hosts).select("kind", "key")
    labelled = anchored_windows(seen.join(wide, ["kind", "key"], "left_semi"), window)
    first = (labelled.groupBy("kind", "key", "anchor", "host")
             .agg(F.min(F.struct("us", "seq")).alias("at")))
    order = Window.partitionBy("kind", "key", "anchor").orderBy("at")
    # The row_number filter keeps min_hosts rows per group before the shuffle as well.
    reached = (first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= min_hosts)
               .groupBy("kind", "key", "anchor")
               .agg(F.array_sort(F.collect_list("host")).alias("hosts"), F.max("at").alias("at"))
               .filter(F.size("hosts") == min_hosts))
    joined = F.array_join("hosts", ", ")
    summary = F.when(F.col("kind") == "lateral-movement",
                     F.format_string("technique %s seen on %d hosts: %s", "key", F.size("hosts"), joined)) \
        .otherwise(F.format_string("%d hosts contacted %s: %s", F.size("hosts"), "key", joined))
    return reached.select("kind", "key", "hosts", F.timestamp_micros("anchor").alias("first_seen"),
                          F.timestamp_micros("at.us").alias("last_seen"), summary.alias("summary"),
                          F.col("at.seq").alias("seq"))
