"""Flat and standard-schema projections of events, alerts and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import base_name, event_detail
from ..schema import literal_map, micros, rank_of

ECS_VERSION, OCSF_VERSION, ATTACK_VERSION = "8.11", "1.3.0", "14.1"

# Verb -> ECS category and type.
ECS_CATEGORY = {"exec": "process", "fork": "process", "exit": "process", "exec_blocked": "process",
                "open": "file", "unlink": "file", "rename": "file", "chmod": "file",
                "connect": "network", "accept": "network"}
ECS_TYPE = {"exec": "start", "fork": "start", "exit": "end", "exec_blocked": "denied",
            "open": "change", "unlink": "deletion", "rename": "change", "chmod": "change",
            "connect": "connection", "accept": "connection"}

# OCSF class uid -> (category uid, category name, class name).
OCSF_CLASS = {1007: (1, "System Activity", "Process Activity"),
              1001: (1, "System Activity", "File System Activity"),
              4001: (4, "Network Activity", "Network Activity"),
              4003: (4, "Network Activity", "DNS Activity")}
# Verb -> (OCSF class uid, activity id, activity name).
OCSF_ACTIVITY = {"exec": (1007, 1, "Launch"), "fork": (1007, 1, "Launch"), "exit": (1007, 2, "Terminate"),
                 "exec_blocked": (1007, 99, "Other"), "ptrace": (1007, 4, "Inject"), "bpf": (1007, 99, "Other"),
                 "module_load": (1007, 99, "Other"), "memfd_create": (1007, 99, "Other"),
                 "mmap_exec": (1007, 99, "Other"), "setuid": (1007, 5, "Set User ID"),
                 "tamper": (1007, 99, "Other"), "open": (1001, 1, "Create"), "unlink": (1001, 4, "Delete"),
                 "rename": (1001, 5, "Rename"), "chmod": (1001, 6, "Set Attributes"),
                 "connect": (4001, 1, "Open"), "accept": (4001, 1, "Open"), "dns": (4003, 1, "Query")}


def _some(path: str) -> Column:
    return F.nullif(F.col(path), F.lit(""))


def _text(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(""))


def _num(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0))


def _rfc3339(ts: Column) -> Column:
    """UTC, fraction trimmed of trailing zeros."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    return F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def hunt_rows(df: DataFrame) -> DataFrame:
    """The 12-column flat row of a hunt result."""
    ip, port = _text("network.dst_ip"), _num("network.dst_port")
    destination = F.when((ip != "") & (port != 0), F.concat_ws(":", ip, port.cast("string"))).otherwise(ip)
    return df.select(
        F.col("ts").alias("time"), _text("host").alias("host"), "action", _num("process.pid").alias("pid"),
        _text("process.name").alias("process"), _text("process.executable").alias("executable"),
        _text("process.command_line").alias("command_line"), _text("process.parent_name").alias("parent"),
        _text("user.name").alias("user"), destination.alias("destination"),
        _text("network.domain").alias("domain"), _text("file.path").alias("file"))


def _ecs(kind: str) -> list[Column]:
    listed = lambda table: F.when(F.col("action").isin(*table), F.array(literal_map(table)[F.col("action")]))
    ppid = _num("process.ppid")
    process = F.struct(
        _num("process.pid").alias("pid"), _text("process.name").alias("name"),
        _some("process.executable").alias("executable"), _some("process.command_line").alias("command_line"),
        F.when(_some("process.sha256").isNotNull(),
               F.struct(F.col("process.sha256").alias("sha256"))).alias("hash"),
        F.when(ppid != 0, F.struct(ppid.alias("pid"), _text("process.parent_name").alias("name"),
                                   _text("process.parent_executable").alias("executable"))).alias("parent"))
    geo = F.when(_some("network.geo_country").isNotNull(),
                 F.struct(F.col("network.geo_country").alias("country_iso_code")))
    return [
        _rfc3339(F.col("ts")).alias("@timestamp"), F.col("schema_version"),
        F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"),
        F.struct(F.lit(kind).alias("kind"), F.col("action"), listed(ECS_CATEGORY).alias("category"),
                 listed(ECS_TYPE).alias("type")).alias("event"),
        process.alias("process"),
        F.struct(_num("user.id").alias("id"), _text("user.name").alias("name")).alias("user"),
        F.when(_some("host").isNotNull(), F.struct(
            F.col("host").alias("name"), F.struct(F.lit("linux").alias("type")).alias("os"))).alias("host"),
        F.when(_some("file.path").isNotNull(), F.struct(
            F.col("file.path").alias("path"), _some("file.target").alias("target_path"))).alias("file"),
        F.when(_some("network.src_ip").isNotNull(), F.struct(
            F.col("network.src_ip").alias("ip"), _num("network.src_port").alias("port"))).alias("source"),
        F.when(_some("network.dst_ip").isNotNull(), F.struct(
            F.col("network.dst_ip").alias("ip"), _num("network.dst_port").alias("port"),
            geo.alias("geo"))).alias("destination"),
        F.when(_some("network.domain").isNotNull(), F.struct(
            F.struct(F.col("network.domain").alias("name")).alias("question"))).alias("dns"),
        F.when(_some("container.id").isNotNull(), F.struct(
            F.col("container.id").alias("id"), _text("container.runtime").alias("runtime"))).alias("container"),
    ]


def to_ecs_event(df: DataFrame) -> DataFrame:
    return df.select("seq", *_ecs("event"))


def to_ecs_alert(alerts: DataFrame) -> DataFrame:
    response = (F.when(F.col("response_action").isNotNull(),
                       F.struct(F.col("response_action").alias("action"), F.col("response_result").alias("result")))
                if "response_action" in alerts.columns else F.lit(None).cast("struct<action:string,result:string>"))
    edr = F.struct(
        F.struct(F.col("rule.id").alias("id"), F.col("rule.name").alias("name")).alias("rule"),
        F.col("rule.severity").alias("severity"), F.struct(F.col("rule.technique").alias("technique")).alias("threat"),
        F.when(F.col("rule.risk_score") > 0, F.col("rule.risk_score")).alias("risk_score"),
        response.alias("response"))
    return alerts.select("seq", *_ecs("alert"), edr.alias("edr"))


def to_ecs_incident(incidents: DataFrame) -> DataFrame:
    detail = F.struct("id", "risk_score", "status", "techniques", "rule_ids", "summary", "process_key",
                      _rfc3339(F.col("first_seen")).alias("first_seen"),
                      _rfc3339(F.col("last_seen")).alias("last_seen"))
    return incidents.select(
        _rfc3339(F.col("last_seen")).alias("@timestamp"), F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"),
        F.struct(F.lit("alert").alias("kind"), F.array(F.lit("intrusion_detection")).alias("category"),
                 F.array(F.lit("info")).alias("type")).alias("event"),
        F.struct(F.col("host").alias("name")).alias("host"), F.struct(detail.alias("incident")).alias("edr"))


def _ocsf_metadata(product: str, vendor: str) -> Column:
    return F.struct(F.lit(OCSF_VERSION).alias("version"),
                    F.struct(F.lit(product).alias("name"), F.lit(vendor).alias("vendor_name")).alias("product"))


def _ocsf_process() -> Column:
    exe, sha = _some("process.executable"), _some("process.sha256")
    file = F.struct(
        F.lit(1).alias("type_id"), F.lit("Regular File").alias("type"), exe.alias("path"),
        base_name(exe).alias("name"),
        F.when(sha.isNotNull(), F.array(F.struct(F.lit(3).alias("algorithm_id"), F.lit("SHA-256").alias("algorithm"),
                                                 sha.alias("value")))).alias("hashes"))
    return F.struct(_num("process.pid").alias("pid"), _text("process.name").alias("name"),
                    _some("process.command_line").alias("cmd_line"),
                    F.when(exe.isNotNull() | sha.isNotNull(), file).alias("file"))


def _ocsf_device() -> Column:
    container = F.when(_some("container.id").isNotNull(), F.struct(
        F.col("container.id").alias("uid"), _text("container.runtime").alias("runtime")))
    return F.when(_some("host").isNotNull(), F.struct(
        F.col("host").alias("hostname"), F.lit(0).alias("type_id"),
        F.struct(F.lit("Linux").alias("name"), F.lit(200).alias("type_id"), F.lit("Linux").alias("type")).alias("os"),
        container.alias("container")))


def _ocsf_event(product: str, vendor: str) -> list[Column]:
    activity = literal_map({v: c for v, (c, _, _) in OCSF_ACTIVITY.items()})[F.col("action")]
    class_uid = F.coalesce(activity, F.lit(1007))
    activity_id = F.coalesce(literal_map({v: a for v, (_, a, _) in OCSF_ACTIVITY.items()})[F.col("action")], F.lit(0))
    activity_name = F.coalesce(literal_map({v: n for v, (_, _, n) in OCSF_ACTIVITY.items()})[F.col("action")],
                               F.lit("Unknown"))
    of_class = lambda i: literal_map({u: row[i] for u, row in OCSF_CLASS.items()})[class_uid]
    is_process, is_file, is_net = class_uid == 1007, class_uid == 1001, class_uid.isin(4001, 4003)
    parent = F.struct(F.struct(_num("process.ppid").alias("pid"), _text("process.parent_name").alias("name"),
                               F.lit(None).cast("string").alias("cmd_line"),
                               F.lit(None).cast(_FILE_TYPE).alias("file")).alias("process"))
    endpoint = lambda side: F.when(is_net & _some(f"network.{side}_ip").isNotNull(), F.struct(
        F.col(f"network.{side}_ip").alias("ip"), _num(f"network.{side}_port").alias("port")))
    path = _some("file.path")
    return [
        _ocsf_metadata(product, vendor).alias("metadata"), F.unix_millis("ts").alias("time"),
        of_class(0).alias("category_uid"), of_class(1).alias("category_name"), class_uid.alias("class_uid"),
        of_class(2).alias("class_name"), activity_id.alias("activity_id"), activity_name.alias("activity_name"),
        (class_uid * 100 + activity_id).alias("type_uid"), F.lit(1).alias("severity_id"),
        F.lit("Informational").alias("severity"),
        F.when(is_process, _ocsf_process()).alias("process"),
        F.when(is_process & (_num("process.ppid") != 0), parent)
        .when(~is_process, F.struct(_ocsf_process().alias("process"))).alias("actor"),
        F.when(is_file & path.isNotNull(), F.struct(
            path.alias("path"), base_name(path).alias("name"), F.lit(1).alias("type_id"),
            F.lit("Regular File").alias("type"))).alias("file"),
        F.when(is_file & path.isNotNull(), _some("file.target")).alias("new_path"),
        endpoint("src").alias("src_endpoint"), endpoint("dst").alias("dst_endpoint"),
        F.when(is_net & _some("network.domain").isNotNull(),
               F.struct(F.col("network.domain").alias("hostname"))).alias("query"),
        _ocsf_device().alias("device"),
    ]


_FILE_TYPE = ("struct<type_id:int,type:string,path:string,name:string,"
              "hashes:array<struct<algorithm_id:int,algorithm:string,value:string>>>")


def to_ocsf_event(df: DataFrame, product: str = "duskwatch", vendor: str = "duskwatch") -> DataFrame:
    return df.select("seq", *_ocsf_event(product, vendor))


def to_ocsf_finding(alerts: DataFrame, product: str = "duskwatch", vendor: str = "duskwatch") -> DataFrame:
    technique = F.col("rule.technique")
    attack = F.struct(
        F.lit(ATTACK_VERSION).alias("version"),
        F.struct(technique["id"].alias("uid"), technique["name"].alias("name")).alias("technique"),
        F.when(F.coalesce(technique["tactic"], F.lit("")) != "",
               F.struct(technique["tactic"].alias("name"))).alias("tactic"))
    # Severity -> OCSF severity id.
    severity_id = rank_of(F.col("rule.severity"), {"low": 2, "medium": 3, "high": 4, "critical": 5})
    return alerts.select(
        "seq", _ocsf_metadata(product, vendor).alias("metadata"), F.unix_millis("ts").alias("time"),
        F.lit(2).alias("category_uid"), F.lit("Findings").alias("category_name"), F.lit(2004).alias("class_uid"),
        F.lit("Detection Finding").alias("class_name"), F.lit(1).alias("activity_id"),
        F.lit("Create").alias("activity_name"), F.lit(200401).alias("type_uid"), severity_id.alias("severity_id"),
        F.when(severity_id > 0, F.initcap("rule.severity")).otherwise("Unknown").alias("severity"),
        F.struct(F.col("rule.id").alias("uid"), F.col("rule.name").alias("title"),
                 F.col("rule.description").alias("desc")).alias("finding_info"),
        F.when(F.coalesce(technique["id"], F.lit("")) != "", F.array(attack)).alias("attacks"),
        F.when(F.col("rule.risk_score") > 0, F.col("rule.risk_score")).alias("risk_score"),
        F.array(F.struct(*_ocsf_event(product, vendor))).alias("evidences"),
        _ocsf_process().alias("process"), _ocsf_device().alias("device"))


def alert_id(*parts: str | Column) -> Column:
    """A 128-bit hex id from the record's identity, so a rerun writes the same ids."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in cols]), 256), 1, 32)


def flatten_alerts(alerts: DataFrame) -> DataFrame:
    """The 15-column fleet record of each alert, plus ``seq``."""
    return alerts.select(
        # What happened and which rule said so: other rules, files or a replay don't change it.
        alert_id(F.lit("alert"), _text("host"), micros("ts"), "rule.id", _text("action"), _num("process.pid"), _num("process.ppid"),
                 _text("process.name"), _text("process.executable"), _text("process.command_line"), _text("file.path"), _text("file.target"),
                 _text("network.dst_ip"), _num("network.dst_port"), _text("network.domain")).alias("id"),
        _text("host").alias("agent_id"), _text("host").alias("hostname"), F.col("ts").alias("time"),
        F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("rule_name"),
        F.col("rule.severity").alias("severity"), F.col("rule.technique.id").alias("technique_id"),
        F.col("rule.technique.name").alias("technique_name"), _num("process.pid").alias("pid"),
        _text("process.name").alias("process_name"), _text("process.executable").alias("process_executable"),
        _text("network.dst_ip").alias("destination_ip"), F.col("rule.risk_score").cast("long").alias("risk_score"),
        F.lit(False).alias("is_incident"), "seq")


def flatten_incidents(incidents: DataFrame) -> DataFrame:
    """Incidents as fleet records: critical, with their first technique."""
    return incidents.select(
        alert_id(F.lit("incident"), "host", "process_key", "id").alias("id"),
        F.col("host").alias("agent_id"), F.col("host").alias("hostname"), F.col("last_seen").alias("time"),
        F.col("id").alias("rule_id"), F.col("summary").alias("rule_name"), F.lit("critical").alias("severity"),
        F.coalesce(F.get("techniques", F.lit(0)), F.lit("")).alias("technique_id"), F.lit("").alias("technique_name"),
        F.lit(0).cast("long").alias("pid"), F.lit("").alias("process_name"), F.lit("").alias("process_executable"),
        F.lit("").alias("destination_ip"), F.col("risk_score").cast("long").alias("risk_score"),
        F.lit(True).alias("is_incident"), "seq")


def pretty_event(df: DataFrame) -> DataFrame:
    """One readable line per event."""
    return df.select("seq", F.format_string(
        "%s %-8s pid=%-7d %-16s %s", F.date_format("ts", "HH:mm:ss.SSS"), "action", _num("process.pid"),
        _text("process.name"), event_detail()).alias("line"))


def pretty_alert(alerts: DataFrame) -> DataFrame:
    technique = F.when(F.coalesce(F.col("rule.technique.id"), F.lit("")) != "",
                       F.format_string(" (%s %s)", "rule.technique.id", "rule.technique.name")).otherwise("")
    return alerts.select("seq", F.format_string(
        "ALERT [%s] %s %s%s — pid=%d %s", F.upper("rule.severity"), "rule.id", "rule.name", technique,
        _num("process.pid"), _text("process.name")).alias("line"))


def pretty_incident(incidents: DataFrame) -> DataFrame:
    return incidents.select("seq", F.format_string(
        "INCIDENT [risk %d] %s — %s (techniques: %s)", "risk_score", "id", "summary",
        F.array_join("techniques", ", ")).alias("line"))
