"""Response and playbook decisions as data; nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import ip_family, ip_hex
from ..schema import rank_of
from .enrich import suppress

MODES = {"off": 0, "dry-run": 1, "enforce": 2}
STEP_TYPES = ("notify", "open_case", "run_hunt", "kill_process", "quarantine")
# Score at or above which each action applies.
KILL, BLOCK, THROTTLE = 90, 75, 50


def response_action() -> Column:
    """Explicit rule action, else the score ladder."""
    own = F.coalesce(F.col("rule.risk_score"), F.lit(0))
    by_severity = rank_of(F.col("rule.severity"), {"critical": KILL, "high": BLOCK, "medium": THROTTLE})
    score = F.when(own > 0, own).otherwise(by_severity)
    has_target = F.coalesce(F.col("network.dst_ip"), F.lit("")) != ""
    return (F.when(F.coalesce(F.col("rule.response"), F.lit("")) != "", F.col("rule.response"))
            .when(score >= KILL, "kill")
            .when((score >= BLOCK) & has_target, "network_block")
            .when(score >= THROTTLE, "throttle")
            .otherwise("alert_only"))


def clamp_posture(requested: str, ceiling: str) -> str:
    """The weaker of two modes; an unknown word means off."""
    rank = min(MODES.get(requested, 0), MODES.get(ceiling, 0))
    return next(name for name, n in MODES.items() if n == rank)


def plan_response(alerts: DataFrame, requested: str = "dry-run", ceiling: str = "enforce",
                  allow: DataFrame | None = None) -> DataFrame:
    """Add action, suppressed, response_action and response_result to each alert.

    In dry-run a due action is recorded as withheld; in enforce it is marked ``planned``
    for whatever carries it out.
    """
    mode = clamp_posture(requested, ceiling)
    df = alerts.withColumn("action_due", response_action())
    df = suppress(df, allow) if allow is not None else df.withColumn("suppressed", F.lit(False))
    due = (F.col("action_due") != "alert_only") & ~F.col("suppressed") & F.lit(mode != "off")
    no_target = F.col("action_due").isin("network_block", "quarantine") \
        & (F.coalesce(F.col("network.dst_ip"), F.lit("")) == "")
    result = (F.lit("dry-run") if mode == "dry-run"
              else F.when(no_target, "no destination to block").otherwise("planned"))
    return df.withColumns({"response_action": F.when(due, F.col("action_due")), "response_result": F.when(due, result)})


def block_list(plan: DataFrame) -> DataFrame:
    """Distinct valid destinations of block actions, with their family."""
    wide = ip_hex(F.col("ip"))
    return (plan.filter(F.col("response_action").isin("network_block", "quarantine"))
            .select(F.col("network.dst_ip").alias("ip")).distinct()
            .withColumn("family", F.when(ip_family(wide) == 4, "ip").when(ip_family(wide) == 6, "ip6"))
            .filter("family is not null"))


PLAYBOOK = ("id string, name string, mode string, "
            "trigger struct<rule_ids:array<string>,severities:array<string>,techniques:array<string>,"
            "min_risk:long,incidents_only:boolean>, steps array<struct<type:string,query:string>>")


def check_playbook(book: dict) -> None:
    if not (book.get("name") or "").strip():
        raise ValueError("a playbook needs a name")
    if book.get("mode") not in MODES:
        raise ValueError(f"invalid mode {book.get('mode')!r} (want off|dry-run|enforce)")
    if not book.get("steps"):
        raise ValueError("a playbook needs at least one step")
    for number, step in enumerate(book["steps"]):
        if step.get("type") not in STEP_TYPES:
            raise ValueError(f"step {number}: unknown type {step.get('type')!r}")
        if step["type"] == "run_hunt" and not (step.get("query") or "").strip():
            raise ValueError(f"step {number}: run_hunt needs a query")


def playbook_frame(spark: SparkSession, books: list[dict]) -> DataFrame:
    """Checked playbooks as a table."""
    rows = []
    for book in books:
        check_playbook(book)
        t = book.get("trigger") or {}
        rows.append((book["id"], book["name"], book["mode"],
                     (list(t.get("rule_ids") or []), list(t.get("severities") or []), list(t.get("techniques") or []),
                      int(t.get("min_risk") or 0), bool(t.get("incidents_only"))),
                     [(s["type"], s.get("query") or "") for s in book["steps"]]))
    return spark.createDataFrame(rows, PLAYBOOK)


def match_playbooks(records: DataFrame, books: list[dict]) -> DataFrame:
    """(alert record, playbook) pairs whose trigger matches; empty lists are wildcards.

    The driver-held playbook list becomes one boolean per playbook, evaluated in a single
    narrow pass, so no row pairs are formed; only matches are expanded.
    """
    spark = records.sparkSession
    for book in books:
        check_playbook(book)
    ids = [b["id"] for b in books]
    if len(set(ids)) < len(ids):
        raise ValueError(f"playbook ids are not unique: {sorted({i for i in ids if ids.count(i) > 1})}")
    live = [b for b in books if b["mode"] != "off"]
    tests = []
    for number, book in enumerate(live):
        t = book.get("trigger") or {}
        test = F.col("risk_score") >= int(t.get("min_risk") or 0)
        if t.get("incidents_only"):
            test = test & F.col("is_incident")
        if t.get("rule_ids"):
            test = test & F.col("rule_id").isin(list(t["rule_ids"]))
        if t.get("severities"):
            test = test & F.lower("severity").isin([s.lower() for s in t["severities"]])
        if t.get("techniques"):
            test = test & F.col("technique_id").isin(list(t["techniques"]))
        tests.append(F.when(test, F.lit(number)))
    numbers = F.array(*tests) if tests else F.array().cast("array<int>")
    table = playbook_frame(spark, live)
    # The id is unique, so the number's id is all that a match needs to find its playbook.
    named = F.get(F.array(*[F.lit(b["id"]) for b in live]), F.col("_book")) if live else F.lit(None).cast("string")
    hits = records.withColumn("_book", F.explode(F.array_compact(numbers))).withColumn("_id", named).drop("_book")
    books_by_id = table.select(F.col("id").alias("_id"), F.struct(*table.columns).alias("playbook"))
    return hits.join(books_by_id, "_id").drop("_id")


def expand_steps(matches: DataFrame, force_dry_run: bool = False) -> DataFrame:
    """One outcome row per step of each matched playbook.

    Outside enforce only read-only steps (a hunt) run; the rest say what they would do.
    """
    step = F.col("step")
    dry = F.lit(True) if force_dry_run else F.col("playbook.mode") != "enforce"
    pid, host, ip = F.col("pid").cast("string"), F.col("hostname"), F.col("destination_ip")
    would = (F.when(step["type"] == "notify", F.concat(F.lit("notify on "), "rule_id"))
             .when(step["type"] == "open_case", F.concat(F.lit("open a case for "), host))
             .when(step["type"] == "kill_process", F.concat(F.lit("ask "), host, F.lit(" to kill pid "), pid))
             .when(step["type"] == "quarantine", F.concat(F.lit("quarantine "), ip, F.lit(" on "), host))
             .otherwise(step["type"]))
    title = F.when(F.col("rule_name") == "", F.concat(F.lit("Incident on "), host)).otherwise(F.col("rule_name"))
    does = (F.when(step["type"] == "notify", F.format_string("notify %s: risk %d on %s", "rule_name", "risk_score", host))
            .when(step["type"] == "open_case", F.concat(F.lit("open case "), title))
            .when(step["type"] == "run_hunt", F.concat(F.lit("hunt "), step["query"]))
            .when(step["type"] == "kill_process", F.concat(F.lit("kill pid "), pid))
            .otherwise(F.concat(F.lit("quarantine "), ip)))
    withheld = dry & (step["type"] != "run_hunt")
    missing = ~withheld & (step["type"] == "quarantine") & (F.coalesce(ip, F.lit("")) == "")
    return (matches.select("*", F.posexplode("playbook.steps").alias("position", "step"))
            .select(F.col("id").alias("alert_id"), "seq", "rule_id", F.col("playbook.id").alias("playbook_id"),
                    F.when(F.lit(force_dry_run), "dry-run").otherwise(F.col("playbook.mode")).alias("mode"),
                    "position", step["type"].alias("type"),
                    F.when(withheld, F.concat(F.lit("would "), would)).otherwise(does).alias("detail"),
                    (~withheld & ~missing).alias("executed"),
                    F.when(missing, "missing target (no pid or destination on the alert)").otherwise("").alias("error")))
