"""The rule-visible field registry: dotted name -> column, null when absent.

Presence depends on the field: empty strings are absent, some numbers are absent
at zero, the others are always present (a missing value reads as 0 / false).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VERBS


# Field name -> (kind, column path, when it is absent).
FIELDS: dict[str, tuple[str, str, str]] = {
    "event.type": ("string", "action", "empty"),
    "event.action": ("string", "action", "empty"),
    "host.name": ("string", "host", "empty"),
    "process.pid": ("long", "process.pid", "never"),
    "process.ppid": ("long", "process.ppid", "never"),
    "process.name": ("string", "process.name", "empty"),
    "process.executable": ("string", "process.executable", "empty"),
    "process.command_line": ("string", "process.command_line", "empty"),
    "process.stdio_socket": ("bool", "process.stdio_socket", "never"),
    "process.hash.sha256": ("string", "process.sha256", "empty"),
    "process.parent.name": ("string", "process.parent_name", "empty"),
    "process.parent.executable": ("string", "process.parent_executable", "empty"),
    "yara.matched": ("string", "process.yara_matches", "no elements"),
    "user.id": ("long", "user.id", "never"),
    "user.name": ("string", "user.name", "empty"),
    "file.path": ("string", "file.path", "empty"),
    "file.target": ("string", "file.target", "empty"),
    "file.flags": ("long", "file.flags", "never"),
    "file.mode": ("long", "file.mode", "never"),
    "source.ip": ("string", "network.src_ip", "empty"),
    "source.port": ("long", "network.src_port", "zero"),
    "destination.ip": ("string", "network.dst_ip", "empty"),
    "destination.port": ("long", "network.dst_port", "zero"),
    "dns.question.name": ("string", "network.domain", "empty"),
    "container.id": ("string", "container.id", "empty"),
    "container.runtime": ("string", "container.runtime", "empty"),
    "syscall.request": ("long", "syscall.request", "never"),
    "syscall.target_pid": ("long", "syscall.target_pid", "zero"),
    "syscall.new_uid": ("long", "syscall.new_uid", "never"),
    "anomaly.score": ("long", "anomaly_score", "never"),
}


def known_fields() -> list[str]:
    return sorted(FIELDS)


def event_classes() -> list[str]:
    return ["any", "event", *sorted(VERBS.values())]


def field_kind(name: str) -> str:
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}")
    return FIELDS[name][0]


def plain_text(name: str) -> Column | None:
    """The stored column of a text field that is absent when empty, else None.

    A test that is false on an empty string may use it directly and stay a smaller plan.
    """
    kind, path, absent = FIELDS[name]
    return F.col(path) if kind == "string" and absent == "empty" else None


def field(name: str) -> Column:
    field_kind(name)
    kind, path, absent = FIELDS[name]
    column = F.col(path)
    if absent == "empty":
        return F.when(column != "", column)
    if absent == "no elements":
        return F.when(F.size(column) > 0, F.array_join(column, ","))
    if name == "anomaly.score":
        return (F.coalesce(column, F.lit(0.0)) * 100 + 0.5).cast("long")
    if absent == "zero":
        return F.when(column != 0, column.cast("long"))
    if kind == "bool":
        return F.coalesce(column, F.lit(False))
    return F.coalesce(column.cast("long"), F.lit(0).cast("long"))


def process_key() -> Column:
    """``pid:start``; pair it with the host in any fleet-wide grouping."""
    return F.concat_ws(":", field("process.pid").cast("string"),
                       F.coalesce(F.col("process.start_time_ns"), F.lit(0)).cast("string"))


def search_text() -> Column:
    """The lower-cased haystack of a lake text search; empties keep their space."""
    paths = ["process.name", "process.executable", "process.command_line", "file.path",
             "file.target", "network.dst_ip", "network.domain", "host"]
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in paths]))


def base_name(path: Column) -> Column:
    """Last path element; a path that ends in a slash is returned whole."""
    tail = F.substring_index(path, "/", -1)
    return F.when(path.contains("/") & (tail != ""), tail).otherwise(path)


def event_detail() -> Column:
    """What one line says about an event, by verb."""
    n = lambda p: F.coalesce(F.col(p), F.lit(0)).cast("string")
    s = lambda p: F.coalesce(F.col(p), F.lit(""))
    flow = F.concat(s("network.src_ip"), F.lit(":"), n("network.src_port"), F.lit(" -> "),
                    s("network.dst_ip"), F.lit(":"), n("network.dst_port"))
    return (
        F.when(F.col("action").isin("exec", "exec_blocked"), s("process.command_line"))
        .when(F.col("action").isin("connect", "accept"), flow)
        .when(s("file.target") != "", F.concat(s("file.path"), F.lit(" -> "), s("file.target")))
        .otherwise(s("file.path"))
    )
