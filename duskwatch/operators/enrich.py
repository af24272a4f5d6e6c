"""Context for events: process tree as of event time, users, containers, content."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf
from .joins import lookup_join
from .ordered import BUCKET, nearest, time_bucket

LIFECYCLE = ("exec", "exec_blocked", "fork", "exit")


def lifecycle(df: DataFrame) -> DataFrame:
    """Process table updates: what each exec / fork / exit writes under its pid."""
    executed = F.col("action").isin("exec", "exec_blocked")
    entry = F.struct(
        (F.col("action") != "exit").alias("alive"),
        F.coalesce("process.name", F.lit("")).alias("name"),
        F.when(executed, F.coalesce("process.executable", F.lit(""))).otherwise(F.lit("")).alias("executable"),
        F.coalesce("process.ppid", F.lit(0)).alias("ppid"),
        F.coalesce("process.start_time_ns", F.lit(0)).alias("start"),
    )
    return df.filter(F.col("action").isin(*LIFECYCLE)).select(
        F.coalesce("host", F.lit("")).alias("_host"), F.coalesce("process.pid", F.lit(0)).alias("_pid"),
        "ts", "seq", entry.alias("_entry"))


def process_as_of(probes: DataFrame, updates: DataFrame, out: str, bucket: timedelta = BUCKET) -> DataFrame:
    """The live process-table entry under ``_pid`` at each probe, null if none or exited.

    An event's own update is applied before its lookup.
    """
    payload = F.struct(*[F.col(c) for c in probes.columns])
    both = (
        probes.select(F.coalesce("host", F.lit("")).alias("_host"), "_pid", "ts", "seq", F.lit(1).alias("_turn"),
                      F.lit(None).cast(updates.schema["_entry"].dataType).alias("_entry"), payload.alias("_row"))
        .unionByName(updates.withColumns({"_turn": F.lit(0), "_row": F.lit(None)}))
    )
    found = nearest(both, ["_host", "_pid"], ["ts", "seq", "_turn"], F.col("_entry"), "_hit",
                    time_bucket(bucket))
    live = F.when(F.col("_hit.alive"), F.col("_hit"))
    return found.filter("_row is not null").select("_row.*", live.alias(out))


def with_parent(df: DataFrame, bucket: timedelta = BUCKET) -> DataFrame:
    """Name and executable of the parent as of the event; recorded ones stay if unknown."""
    probes = df.withColumn("_pid", F.coalesce("process.ppid", F.lit(0)))
    hit = process_as_of(probes, lifecycle(df), "_parent", bucket)
    known = F.col("_parent").isNotNull()
    process = F.col("process") \
        .withField("parent_name", F.when(known, F.col("_parent.name")).otherwise(F.col("process.parent_name"))) \
        .withField("parent_executable",
                   F.when(known, F.col("_parent.executable")).otherwise(F.col("process.parent_executable")))
    return hit.withColumn("process", process).drop("_pid", "_parent")


def with_start(df: DataFrame, bucket: timedelta = BUCKET) -> DataFrame:
    """Stamp a missing start time from the process's own live entry."""
    probes = df.withColumn("_pid", F.coalesce("process.pid", F.lit(0)))
    hit = process_as_of(probes, lifecycle(df), "_self", bucket)
    recorded = F.coalesce("process.start_time_ns", F.lit(0))
    start = F.when((recorded == 0) & F.col("_self").isNotNull(), F.col("_self.start")).otherwise(recorded)
    return hit.withColumn("process", F.col("process").withField("start_time_ns", start)).drop("_pid", "_self")


def ancestry(df: DataFrame, depth: int | None = None, bucket: timedelta = BUCKET) -> DataFrame:
    """(host, seq, ancestors): process names up the parent chain as of each event.

    One as-of lookup per level over rows that are still climbing, against the updates of the
    processes they ask for; each level is one table in the shared folder that carries the chain
    so far, and the climb stops when no row is left. A chain ends where it comes
    back to a process it has passed (reused process numbers can close a ring); ``depth`` asks
    for the nearest ancestors only.
    """
    shelf = Shelf(df.sparkSession)
    updates = shelf.save(lifecycle(df), "updates")
    moving = (F.col("_pid") != 0) & ~F.array_contains("_passed", F.col("_pid"))
    frontier = df.select("host", "ts", "seq", F.coalesce("process.ppid", F.lit(0)).alias("_pid"),
                         F.array(F.coalesce("process.pid", F.lit(0))).alias("_passed"), F.array().cast("array<string>").alias("ancestors"))
    ended, level = [], 0
    while depth is None or level < depth:
        frontier = frontier.filter(moving)
        asked = frontier.select(F.coalesce("host", F.lit("")).alias("_host"), "_pid").distinct()
        hit = process_as_of(frontier, updates.join(asked, ["_host", "_pid"], "left_semi"), "_up", bucket)
        # A row without an entry has a null ``_pid``: it ends with the chain it came with.
        frontier = shelf.save(hit.select(
            "host", "ts", "seq", F.col("_up.ppid").alias("_pid"), F.array_append("_passed", F.col("_pid")).alias("_passed"),
            F.when(F.col("_up").isNull(), F.col("ancestors")).otherwise(F.array_append("ancestors", F.col("_up.name"))).alias("ancestors")), f"level-{level}")
        ended.append(frontier.filter(~F.coalesce(moving, F.lit(False)) & (F.size("ancestors") > 0)).select("host", "seq", "ancestors"))
        level += 1
        if frontier.filter(moving).isEmpty():
            break
    else:
        ended.append(frontier.filter(moving & (F.size("ancestors") > 0)).select("host", "seq", "ancestors"))
    # Repeated events share one chain, by a shuffle that a join by event uses again.
    return reduce(DataFrame.unionByName, ended).groupBy("host", "seq").agg(F.max_by("ancestors", F.size("ancestors")).alias("ancestors"))


def with_ancestry(df: DataFrame, depth: int | None = None, bucket: timedelta = BUCKET) -> DataFrame:
    chains = ancestry(df, depth, bucket).withColumnRenamed("ancestors", "_chain")
    return (df.join(chains, ["host", "seq"], "left")
            .withColumn("process", F.col("process").withField("ancestors", F.col("_chain"))).drop("_chain"))


def with_user(df: DataFrame, users: DataFrame) -> DataFrame:
    """Fill an empty user name from a (uid, user_name) table."""
    names = users.groupBy(F.col("uid").cast("long").alias("_uid")).agg(F.max("user_name").alias("_name"))
    joined = lookup_join(df.withColumn("_uid", F.coalesce("user.id", F.lit(0))), names, ["_uid"])
    name = F.coalesce(F.nullif("user.name", F.lit("")), F.col("_name"), F.lit(""))
    return joined.withColumn("user", F.col("user").withField("name", name)).drop("_uid", "_name")


# Cgroup path markers in the order they are tried.
RUNTIME_MARKERS = (("docker", "docker"), ("crio", "cri-o"), ("containerd", "containerd"),
                   ("kubepods", "containerd"), ("libpod", "podman"))


def container_id(cgroup):
    return F.nullif(F.regexp_extract(cgroup, "[0-9a-f]{64}|[0-9a-f]{32}", 0), F.lit(""))


def container_runtime(cgroup):
    chain = F.when(F.lit(False), F.lit(""))
    for marker, runtime in RUNTIME_MARKERS:
        chain = chain.when(cgroup.contains(marker), runtime)
    return F.when(container_id(cgroup).isNotNull(), chain.otherwise(""))


def with_container(df: DataFrame, cgroup: str = "cgroup") -> DataFrame:
    """Container id and runtime from a cgroup path column, kept if already set."""
    path = F.coalesce(F.col(cgroup), F.lit(""))
    empty = F.coalesce(F.col("container.id"), F.lit("")) == ""
    return df.withColumn("container", F.struct(
        F.when(empty, container_id(path)).otherwise(F.col("container.id")).alias("id"),
        F.when(empty, container_runtime(path)).otherwise(F.col("container.runtime")).alias("runtime")))


def _for_executable(df: DataFrame, lookup: DataFrame, missing, value: str) -> DataFrame:
    """Join a per-path lookup to exec events that still lack the value."""
    wanted = F.col("action").isin("exec", "exec_blocked") & missing
    path = F.when(wanted, F.nullif(F.col("process.executable"), F.lit("")))
    right = lookup.select(F.col("path").alias("_path"), F.col(value).alias("_found"))
    return lookup_join(df.withColumn("_path", path), right, ["_path"])


def with_hash(df: DataFrame, content: DataFrame) -> DataFrame:
    """sha256 of the executable from a (path, content) table; each file is hashed once."""
    hashes = content.groupBy("path").agg(F.max(F.sha2("content", 256)).alias("sha256"))
    joined = _for_executable(df, hashes, F.coalesce(F.col("process.sha256"), F.lit("")) == "", "sha256")
    value = F.coalesce(F.nullif(F.col("process.sha256"), F.lit("")), F.col("_found"))
    return joined.withColumn("process", F.col("process").withField("sha256", value)).drop("_path", "_found")


def with_signatures(df: DataFrame, scanned: DataFrame) -> DataFrame:
    """Content-signature matches of the executable from a (path, matches) table."""
    none = F.coalesce(F.size("process.yara_matches"), F.lit(0)) <= 0
    joined = _for_executable(df, scanned, none, "matches")
    value = F.when(none, F.col("_found")).otherwise(F.col("process.yara_matches"))
    return joined.withColumn("process", F.col("process").withField("yara_matches", value)).drop("_path", "_found")


def tactic_index(rules: DataFrame) -> DataFrame:
    """technique_id -> tactic; the last rule in order wins."""
    return (rules.filter(F.coalesce(F.col("technique.id"), F.lit("")) != "")
            .groupBy(F.col("technique.id").alias("technique_id"))
            .agg(F.max_by("technique.tactic", "ord").alias("tactic")))


def resolve_evidence(evidence: DataFrame, alerts: DataFrame) -> DataFrame:
    """Evidence rows (case_id, ord, id) that name a known alert, with its record; ``ord`` keeps the order."""
    return evidence.select("case_id", "ord", "id").join(alerts, "id")


def suppress(df: DataFrame, allow: DataFrame) -> DataFrame:
    """Flag alerts whose executable must not be acted on."""
    listed = allow.select(F.col("executable").alias("_exe"), F.lit(True).alias("_listed")).filter("_exe <> ''").distinct()
    # Events without an executable have no key, so they spread over all tasks.
    joined = lookup_join(df.withColumn("_exe", F.nullif(F.col("process.executable"), F.lit(""))), listed, ["_exe"])
    return joined.withColumn("suppressed", F.coalesce("_listed", F.lit(False))).drop("_exe", "_listed")
