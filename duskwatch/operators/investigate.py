"""Provenance graph, causal depth, timelines, triage text and alert history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import base_name
from ..schema import DISPLAY_RANK, micros, rank_of
from ..session import materialize
from .enrich import tactic_index
from .joins import lookup_join
from .ordered import newest_first


def _some(path: str) -> Column:
    return F.nullif(F.col(path), F.lit(""))


def _pid(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0))


def _proc(pid: Column) -> Column:
    return F.concat(F.lit("proc:"), pid.cast("string"))


def _endpoint() -> Column:
    ip, port = _some("network.dst_ip"), F.coalesce(F.col("network.dst_port"), F.lit(0))
    return F.when(port != 0, F.concat_ws(":", ip, port.cast("string"))).otherwise(ip)


def _target() -> Column:
    """The one object an event touches: file, else resolved domain, else destination."""
    path, domain, ip = _some("file.path"), _some("network.domain"), _some("network.dst_ip")
    verb = F.coalesce(F.create_map(*[F.lit(x) for kv in {"open": "opened", "unlink": "deleted", "rename": "renamed",
                                                         "chmod": "chmod"}.items() for x in kv])[F.col("action")],
                      F.lit("accessed"))
    make = lambda kind, prefix, label, detail, edge: F.struct(
        F.concat(F.lit(prefix), detail).alias("id"), F.lit(kind).alias("kind"), label.alias("label"),
        detail.alias("detail"), edge.alias("edge"))
    return (F.when(path.isNotNull(), make("file", "file:", base_name(path), path, verb))
            .when((F.col("action") == "dns") & domain.isNotNull(),
                  make("network", "net:", domain, domain, F.lit("resolved")))
            .when(ip.isNotNull(), make("network", "net:", _endpoint(), _endpoint(), F.lit("connected"))))


def _spawns() -> Column:
    return F.col("action").isin("exec", "fork") & (_pid("process.ppid") != 0)


def graph_nodes(df: DataFrame) -> DataFrame:
    """(host, id, kind, label, pid, detail): every process, file and endpoint seen.

    A process is labelled by its first real name in event order and detailed by its last
    command line; both are order statistics, so a hot node combines map-side.
    """
    real = lambda name, exe: F.coalesce(_some(name), base_name(_some(exe)))
    pid, ppid, t = _pid("process.pid"), _pid("process.ppid"), _target()
    make = lambda turn, id, kind, label, number, detail: F.struct(
        F.lit(turn).alias("turn"), id.alias("id"), F.lit(kind).alias("kind") if isinstance(kind, str) else
        kind.alias("kind"), label.alias("label"), number.cast("long").alias("pid"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    seen = F.array(
        make(0, _proc(pid), "process", real("process.name", "process.executable"), pid, _some("process.command_line")),
        F.when(_spawns(), make(1, _proc(ppid), "process", real("process.parent_name", "process.parent_executable"),
                               ppid, none)),
        F.when(t.isNotNull(), make(2, t["id"], t["kind"], t["label"], F.lit(None), t["detail"])))
    rows = (df.select(F.coalesce("host", F.lit("")).alias("host"), micros("ts").alias("us"), "seq",
                      F.explode(F.array_compact(seen)).alias("n"))
            .select("host", F.struct("us", "seq", "n.turn").alias("ord"), "n.*"))
    fallback = F.concat(F.lit("pid "), F.col("pid").cast("string"))
    return (rows.groupBy("host", "id").agg(
        F.max("kind").alias("kind"), F.max("pid").alias("pid"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.col("ord"))).alias("label"),
        F.max_by("detail", F.when(F.col("detail").isNotNull(), F.col("ord"))).alias("detail"))
        .select("host", "id", "kind", F.coalesce("label", fallback).alias("label"), "pid",
                F.coalesce("detail", F.lit("")).alias("detail")))


def graph_edges(df: DataFrame) -> DataFrame:
    """(host, source, target, kind), each once."""
    pid, t = _pid("process.pid"), _target()
    edge = lambda s, d, k: F.struct(s.alias("source"), d.alias("target"), k.alias("kind"))
    both = F.array(F.when(_spawns(), edge(_proc(_pid("process.ppid")), _proc(pid), F.lit("spawned"))),
                   F.when(t.isNotNull(), edge(_proc(pid), t["id"], t["edge"])))
    return (df.select(F.coalesce("host", F.lit("")).alias("host"), F.explode(F.array_compact(both)).alias("e"))
            .select("host", "e.*").distinct())


def annotate(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Mark process nodes with the alerts on their pid; alerts on unknown pids are ignored."""
    rank = rank_of(F.col("severity"), DISPLAY_RANK)
    marks = records.groupBy(F.col("hostname").alias("host"), _proc(F.col("pid")).alias("id")).agg(
        # Bounded by the number of known techniques.
        F.array_sort(F.collect_set(_some("technique_id"))).alias("techniques"),
        F.max_by("severity", F.when(rank > 0, rank)).alias("severity"))
    return (nodes.join(marks, ["host", "id"], "left")
            .withColumns({"alerting": F.col("techniques").isNotNull(),
                          "techniques": F.coalesce("techniques", F.array().cast("array<string>")),
                          "severity": F.coalesce("severity", F.lit(""))}))


def _climb(nodes: DataFrame) -> DataFrame:
    """Pointer doubling: (host, id, top, depth, open) for (host, id, up) parent pointers.

    ``open`` marks nodes that never reach a root, i.e. that sit on or lead into a cycle.
    A chain of length L takes log2(L) rounds, each one unique-key join.
    """
    state = nodes.select("host", "id", F.coalesce("up", "id").alias("top"),
                         F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                         F.col("up").isNotNull().alias("open"))
    state = materialize(state)
    # A pointer over more steps than there are nodes can only be on a cycle.
    for _ in range(state.count().bit_length() + 1):
        if state.filter("open").isEmpty():
            break
        jump = state.select("host", F.col("id").alias("top"), F.col("top").alias("_top"),
                            F.col("depth").alias("_depth"), F.col("open").alias("_open"))
        closed = state.filter(~F.col("open"))
        moved = (lookup_join(state.filter("open"), jump, ["host", "top"], "inner")
                 .select("host", "id", F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"),
                         F.col("_open").alias("open")))
        state = materialize(closed.unionByName(moved))
    return state


def graph_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, id, layer): steps from a root along parents.

    A node's parent is its last spawner in source order, else its first toucher; edges
    from unknown nodes make a root.  A cycle is entered where the smallest id leading
    into it enters, and counted once around from there.
    """
    spawned = F.col("kind") == "spawned"
    parents = edges.groupBy("host", F.col("target").alias("id")).agg(
        F.coalesce(F.max(F.when(spawned, F.col("source"))),
                   F.min(F.when(~spawned, F.col("source")))).alias("up"))
    known = nodes.select("host", F.col("id").alias("up"))
    linked = parents.join(known, ["host", "up"], "left_semi")
    base = materialize(nodes.select("host", "id").join(linked, ["host", "id"], "left"))
    state = _climb(base)
    if state.filter("open").isEmpty():
        return state.select("host", "id", F.col("depth").alias("layer"))
    return _climb(_cut_cycles(base, state)).select(
        "host", "id", F.col("depth").alias("layer")).join(
        base.select("host", "id"), ["host", "id"], "left_semi")


def _cut_cycles(base: DataFrame, state: DataFrame) -> DataFrame:
    """Replace, in each cycle, the pointer into its entry node by one to a fresh root."""
    loose = state.filter("open")
    # All loose pointers have been doubled equally often, to more steps than there are nodes. Along a
    # ring that is a bijection, so they land on every ring node, and on nothing else.
    ring = materialize(loose.select("host", F.col("top").alias("id")).distinct())
    on_ring = base.join(ring, ["host", "id"], "left_semi")
    ring_parent = materialize(on_ring.select("host", "id", "up"))
    # Smallest id on each ring names it: the least of the nodes ahead, by doubling.
    label = ring_parent.select("host", "id", F.col("up").alias("top"), F.col("id").alias("ring"))
    for _ in range(ring_parent.count().bit_length()):
        ahead = label.select("host", F.col("id").alias("top"), F.col("top").alias("_top"), F.col("ring").alias("_ring"))
        label = materialize(label.join(ahead, ["host", "top"]).select(
            "host", "id", F.col("_top").alias("top"), F.least("ring", "_ring").alias("ring")))
    names = label.select("host", "id", "ring")
    # Tails climb to the ring node they hit first.
    open_nodes = base.join(loose.select("host", "id"), ["host", "id"], "left_semi")
    tails = open_nodes.join(ring, ["host", "id"], "left_anti")
    stops = ring.withColumn("up", F.lit(None).cast("string"))
    hits = _climb(tails.unionByName(stops)).select("host", F.col("id").alias("node"), F.col("top").alias("id"))
    entry = (hits.join(names, ["host", "id"])
             .groupBy("host", "ring").agg(F.min_by("id", "node").alias("entry")))
    cut = (ring_parent.join(names, ["host", "id"]).join(entry, ["host", "ring"])
           .filter(F.col("up") == F.col("entry")).select("host", "id", F.lit(True).alias("_cut")))
    marked = base.join(cut, ["host", "id"], "left")
    root = F.concat(F.lit("root of "), F.col("id"))
    rewired = marked.withColumn("up", F.when(F.col("_cut"), root).otherwise(F.col("up"))).drop("_cut")
    roots = cut.select("host", root.alias("id"), F.lit(None).cast("string").alias("up"))
    return rewired.unionByName(roots)


def timeline(records: DataFrame, host: str | None = None) -> DataFrame:
    """Alerts newest first with their process ▶ technique ▶ destination chain."""
    arrow = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("▶ "), F.col(c)))
    process = F.coalesce(F.nullif("process_name", F.lit("")), F.lit("process"))
    chain = F.concat_ws("  ", process, arrow("technique_id"), arrow("destination_ip"))
    rows = records if host is None else records.filter(F.col("hostname") == host)
    return newest_first(rows.withColumn("chain", chain), ts="time")


def query_alerts(records: DataFrame, host: str = "", severity: str = "", technique: str = "",
                 since: datetime | None = None, until: datetime | None = None, incidents_only: bool = False,
                 limit: int | None = None) -> DataFrame:
    """Alert history, newest first; bounds are inclusive. All of it, unless ``limit`` asks for a page."""
    for name, value in (("hostname", host), ("severity", severity), ("technique_id", technique)):
        if value:
            records = records.filter(F.col(name) == value)
    if since is not None:
        records = records.filter(F.col("time") >= F.lit(since))
    if until is not None:
        records = records.filter(F.col("time") <= F.lit(until))
    if incidents_only:
        records = records.filter("is_incident")
    return newest_first(records, limit if limit and limit > 0 else None, ts="time")


def alert_by_id(records: DataFrame, id: str) -> DataFrame:
    return records.filter(F.col("id") == id)


def host_context(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host, all its alerts folded: techniques in order of appearance from the newest on, counts.

    The order is a value of the row, not a row number, so no window gathers a host.
    """
    newest = F.struct((-micros("time")).alias("time"), (-F.col("seq")).alias("seq"), F.col("id").alias("id"))
    return fold_context(records.withColumn("subject", F.col("hostname")).withColumn("ord", newest), rules)


def fold_context(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of a ``subject`` in ``ord`` order -> techniques, alerts, high_alerts, process, risk."""
    counts = rows.groupBy("subject").agg(
        F.count("*").alias("alerts"), F.count_if(F.lower("severity").isin("high", "critical")).alias("high_alerts"),
        F.coalesce(F.min_by(F.struct("process_name", "pid"), F.when(F.col("process_name") != "", F.col("ord"))),
                   F.max_by(F.struct("process_name", "pid"), "ord")).alias("first"),
        F.greatest(F.max("risk_score"), F.lit(0)).alias("risk"))
    techniques = (rows.filter(F.coalesce(F.col("technique_id"), F.lit("")) != "")
                  .groupBy("subject", "technique_id")
                  .agg(F.min("ord").alias("ord"), F.min_by("technique_name", "ord").alias("name"))
                  .join(tactic_index(rules), "technique_id", "left")
                  .groupBy("subject")
                  # One entry per distinct technique.
                  .agg(F.array_sort(F.collect_list(F.struct(
                      "ord", F.col("technique_id").alias("id"), "name",
                      F.coalesce("tactic", F.lit("")).alias("tactic")))).alias("techniques")))
    empty = F.array().cast(techniques.schema["techniques"].dataType)
    return (counts.join(techniques, "subject", "left")
            .withColumn("techniques", F.coalesce("techniques", empty)))


def triage_context(targets: DataFrame, records: DataFrame, rules: DataFrame) -> DataFrame:
    """Each target alert with the folded history of its host."""
    hosts = targets.select("hostname").distinct()
    context = (host_context(records.join(hosts, "hostname", "left_semi"), rules)
               .select(F.col("subject").alias("hostname"), "techniques", "alerts", "high_alerts"))
    return lookup_join(targets, context, ["hostname"], "left")


def _or_unknown(name: str) -> Column:
    return F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", "unknown").otherwise(F.col(name))


def triage_summary(context: DataFrame) -> DataFrame:
    """Add ``summary``, the templated narrative of a context row."""
    names = F.transform("techniques", lambda t: F.trim(F.concat_ws(" ", t["id"], F.coalesce(t["name"], F.lit("")))))
    listed = F.when(F.size("techniques") == 0, "no mapped technique").otherwise(F.array_join(names, ", "))
    # Fixed value: the report sentence.
    text = ("Host %s: process %s (pid %d) accumulated risk %d across %d ATT&CK technique(s) — %s. "
            "%d detection(s) fired, %d high-or-critical. Review the process tree on %s and the "
            "destinations it contacted before deciding on containment.")
    host = _or_unknown("hostname")
    return context.withColumn("summary", F.format_string(
        text, host, _or_unknown("process_name"), "pid", "risk_score", F.size("techniques"), listed,
        "alerts", "high_alerts", host))


def containment(context: DataFrame) -> DataFrame:
    """Add ``steps``: distinct advice per tactic in order, ending with the snapshot step."""
    host, process, pid = _or_unknown("hostname"), _or_unknown("process_name"), F.col("pid").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    # Advice by tactic.
    def advice(t):
        tactic = F.lower(F.trim(t["tactic"]))
        return (F.when(tactic.isin("execution", "privilege-escalation"),
                       say("Kill the offending process ", process, " (pid ", pid, ") and isolate ", host,
                           " from the network."))
                .when(tactic.isin("command-and-control", "exfiltration"),
                      say("Block egress from ", host, " and capture the destination for threat-intel."))
                .when(tactic == "credential-access",
                      say("Rotate credentials exposed on ", host, " and review its authentication logs."))
                .when(tactic == "persistence",
                      say("Audit ", host, " for persistence (cron, systemd units, modified binaries)."))
                .when(tactic == "defense-evasion",
                      say("Preserve forensic state on ", host, " — the actor attempted to evade detection.")))

    final = say("Snapshot ", host, " and preserve volatile memory before remediation.")
    steps = F.array_append(F.array_distinct(F.array_compact(F.transform("techniques", advice))), final)
    return context.withColumn("steps", steps)
