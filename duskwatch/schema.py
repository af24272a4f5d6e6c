"""The event model: one explicit nested schema, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

# Event type number -> action verb.
VERBS = {
    1: "exec", 2: "fork", 3: "exit", 4: "open", 5: "unlink", 6: "rename",
    7: "chmod", 8: "connect", 9: "accept", 10: "exec_blocked", 11: "ptrace",
    12: "module_load", 13: "bpf", 14: "memfd_create", 15: "mmap_exec",
    16: "setuid", 17: "dns", 18: "tamper",
}

# The two severity scales.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
DISPLAY_RANK = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}

PROCESS = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("tid", T.LongType()),
    T.StructField("ppid", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("executable", T.StringType()),
    T.StructField("command_line", T.StringType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("exit_code", T.IntegerType()),
    # Nanoseconds since boot: a long holds 292 years of uptime.
    T.StructField("start_time_ns", T.LongType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("stdio_socket", T.BooleanType()),
    T.StructField("yara_matches", T.ArrayType(T.StringType())),
    T.StructField("parent_name", T.StringType()),
    T.StructField("parent_executable", T.StringType()),
    T.StructField("ancestors", T.ArrayType(T.StringType())),
])
USER = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("flags", T.IntegerType()), T.StructField("mode", T.IntegerType()),
])
NETWORK = T.StructType([
    T.StructField("family", T.IntegerType()),
    T.StructField("src_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("domain", T.StringType()), T.StructField("geo_country", T.StringType()),
])
CONTAINER = T.StructType([T.StructField("id", T.StringType()), T.StructField("runtime", T.StringType())])
SYSCALL = T.StructType([
    T.StructField("request", T.LongType()), T.StructField("target_pid", T.LongType()),
    T.StructField("new_uid", T.LongType()),
])

# What is on the wire: one JSON object per event.
EVENT_JSON = T.StructType([
    T.StructField("@timestamp", T.TimestampType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("cgroup_id", T.LongType()),
    T.StructField("ret", T.IntegerType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("process", PROCESS),
    T.StructField("user", USER),
    T.StructField("file", FILE),
    T.StructField("network", NETWORK),
    T.StructField("container", CONTAINER),
    T.StructField("syscall", SYSCALL),
])

# What operators see: ``ts`` plus ``seq``, the arrival number that breaks ties
# between events of one microsecond.
EVENT = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()),
     T.StructField("event_type", T.IntegerType())]
    + EVENT_JSON.fields[1:]
)


def literal_map(table: dict) -> Column:
    """A constant lookup table as a map column."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def rank_of(column: Column, table: dict[str, int]) -> Column:
    """Rank of a lower-cased word in a small fixed table, 0 when unknown."""
    word = F.lower(column)
    return F.coalesce(
        reduce(lambda acc, kv: acc.when(word == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0)),
        F.lit(0),
    )


def conform(df: DataFrame) -> DataFrame:
    """Fill a partial event frame up to the full schema with typed nulls."""
    def build(dtype: T.StructType, source: T.StructType | None, path: str) -> Column:
        have = {f.name: f.dataType for f in source.fields} if source is not None else {}
        parts = []
        for f in dtype.fields:
            inner = f"{path}.{f.name}"
            parts.append((F.col(inner) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name))
        return F.struct(*parts)

    present = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in EVENT.fields:
        if isinstance(f.dataType, T.StructType):
            columns.append(build(f.dataType, present.get(f.name), f.name).alias(f.name))
        elif f.name in present:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in set(EVENT.fieldNames())]
    return df.select(*columns, *extra)


def normalize(df: DataFrame) -> DataFrame:
    """Default the schema version and keep action and type number in step."""
    action = F.coalesce(F.nullif(F.col("action"), F.lit("")),
                        literal_map(VERBS)[F.col("event_type")], F.lit("unknown"))
    number = F.coalesce(F.nullif(F.col("event_type"), F.lit(0)),
                        literal_map({v: n for n, v in VERBS.items()})[F.col("action")], F.lit(0))
    return df.withColumns({
        "schema_version": F.coalesce(F.nullif(F.col("schema_version"), F.lit("")), F.lit(SCHEMA_VERSION)),
        "event_type": number.cast("int"),
        "action": action,
    })


def micros(column: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)
