"""Case management as folds over an append-only activity log.

Log columns: case_ref, ts, seq, kind (create | assign | status | comment | evidence),
title, severity, host, tags, status, assignee, author, body, alert_id.  A case is never
gathered into one row: comments and evidence stay child tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DISPLAY_RANK, rank_of
from .enrich import resolve_evidence
from .investigate import containment, fold_context, triage_summary
from .ordered import BUCKET, number_rows, time_bucket

STATUSES = ("open", "triage", "closed")


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _ord() -> Column:
    return F.struct("ts", "seq")


def check_log(log: DataFrame) -> DataFrame:
    """Add ``problem``: why an entry is rejected, null if it counts.

    A create needs a title and a known severity; a status must be one of three; anything
    before its case's first good create, or a second create, is rejected.
    """
    create = F.col("kind") == "create"
    bad = (F.when(create & (F.trim(F.coalesce("title", F.lit(""))) == ""), "a case needs a title")
           .when(create & ~_blank("severity") & (rank_of(F.col("severity"), DISPLAY_RANK) == 0), "unknown severity")
           .when((F.col("kind") == "status") & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
                 "invalid status (want open|triage|closed)"))
    marked = log.withColumn("problem", bad)
    born = (marked.filter(create & F.col("problem").isNull())
            .groupBy("case_ref").agg(F.min(_ord()).alias("_born")))
    late = (F.when(F.col("problem").isNotNull(), F.col("problem"))
            .when(F.col("_born").isNull() | (_ord() < F.col("_born")), "case not found")
            .when(create & (_ord() > F.col("_born")), "case exists"))
    return marked.join(born, "case_ref", "left").withColumn("problem", late).drop("_born")


def fold_cases(checked: DataFrame) -> DataFrame:
    """Current snapshot per case, numbered CASE-0001 onwards in order of creation."""
    good = checked.filter("problem is null")
    at = lambda kind: F.when(F.col("kind") == kind, _ord())
    folded = good.groupBy("case_ref").agg(
        F.max_by(F.struct("title", "severity", "host", "tags", "ts", "seq"), at("create")).alias("c"),
        F.coalesce(F.max_by("status", at("status")), F.lit("open")).alias("status"),
        F.coalesce(F.max_by("assignee", at("assign")), F.lit("")).alias("assignee"),
        F.count_if(F.col("kind") == "comment").alias("comments"), F.max("ts").alias("updated"))
    flat = folded.select("case_ref", "c.title", F.coalesce("c.severity", F.lit("")).alias("severity"),
                         F.coalesce("c.host", F.lit("")).alias("host"), "c.tags", "status", "assignee", "comments",
                         F.col("c.ts").alias("created"), "updated", F.col("c.seq").alias("seq"))
    numbered = number_rows(flat, ["created", "seq"], time_bucket(BUCKET, "created"))
    number = F.col("number").cast("string")
    return numbered.withColumn("case_id", F.concat(
        F.lit("CASE-"), F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0")))).drop("number")


def case_evidence(checked: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, id, ord): distinct alert ids of a case by first mention."""
    rows = checked.filter("problem is null").filter(~_blank("alert_id"))
    first = rows.groupBy("case_ref", F.col("alert_id").alias("id")).agg(F.min(_ord()).alias("ord"))
    return first.join(cases.select("case_ref", "case_id"), "case_ref").select("case_id", "id", "ord")


def case_comments(checked: DataFrame, cases: DataFrame) -> DataFrame:
    rows = checked.filter("problem is null and kind = 'comment'")
    return (rows.join(cases.select("case_ref", "case_id"), "case_ref")
            .select("case_id", _ord().alias("ord"), "author", "body", "ts"))


def list_cases(cases: DataFrame, status: str = "", assignee: str = "") -> DataFrame:
    """Cases newest first."""
    if status:
        cases = cases.filter(F.col("status") == status)
    if assignee:
        cases = cases.filter(F.col("assignee") == assignee)
    return cases.orderBy(F.col("created").desc(), F.col("seq").desc())


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def case_report_lines(cases: DataFrame, evidence: DataFrame, comments: DataFrame, records: DataFrame,
                      rules: DataFrame) -> DataFrame:
    """The Markdown report of every case as (case_id, section, ord, line) rows.

    Sort by section and ord within a case to read it.  Lines stay rows because nothing
    bounds the evidence or notes of a case.
    """
    found = resolve_evidence(evidence, records)
    facts = fold_context(found.withColumn("subject", F.col("case_id")), rules)
    story = cases.select("case_id", F.col("host").alias("hostname")) \
        .join(facts.withColumnRenamed("subject", "case_id"), "case_id", "left") \
        .select("case_id", "hostname", F.coalesce("techniques", F.array().cast(facts.schema["techniques"].dataType))
                .alias("techniques"), F.coalesce("alerts", F.lit(0)).alias("alerts"),
                F.coalesce("high_alerts", F.lit(0)).alias("high_alerts"),
                F.coalesce("first.process_name", F.lit("")).alias("process_name"),
                F.coalesce("first.pid", F.lit(0)).alias("pid"), F.coalesce("risk", F.lit(0)).alias("risk_score"))
    story = containment(triage_summary(story))
    none = F.struct(F.timestamp_micros(F.lit(0)).alias("ts"), F.lit(0).cast("long").alias("seq"))
    key = lambda n: F.struct(F.timestamp_micros(F.lit(0)).alias("ts"), n.cast("long").alias("seq"))
    field = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "",
                                        F.concat(F.lit(f"**{label}:** "), value, F.lit("  ")))
    head = F.array(
        F.concat(F.lit("# "), F.col("case_id"), F.lit(" — "), F.col("title")), F.lit(""),
        field("Status", F.col("status")), field("Severity", F.col("severity")), field("Assignee", F.col("assignee")),
        field("Host", F.col("host")), field("Tags", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")),
        field("Opened", _stamp(F.col("created"))), field("Updated", _stamp(F.col("updated"))))
    header = cases.select("case_id", F.posexplode(F.array_compact(head)).alias("n", "line")) \
        .select("case_id", F.lit(0).alias("section"), key(F.col("n")).alias("ord"), "line")
    summary = story.select("case_id", F.posexplode(F.array(F.lit(""), F.lit("## Summary"), F.lit(""), F.col("summary")))
                           .alias("n", "line")) \
        .select("case_id", F.lit(1).alias("section"), key(F.col("n")).alias("ord"), "line")
    steps = F.concat(F.array(F.lit(""), F.lit("## Recommended containment"), F.lit("")),
                     F.transform("steps", lambda s: F.concat(F.lit("- "), s)))
    advice = story.select("case_id", F.posexplode(steps).alias("n", "line")) \
        .select("case_id", F.lit(2).alias("section"), key(F.col("n")).alias("ord"), "line")
    titles = lambda of, section, lines: of.select("case_id").distinct().select(
        "case_id", F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("n", "line")) \
        .select("case_id", F.lit(section).alias("section"), key(F.col("n")).alias("ord"), "line")
    table = found.select("case_id", F.lit(4).alias("section"), "ord", F.format_string(
        "| %s | %s %s | %s | %s |", _stamp(F.col("time")), "rule_id", "rule_name", "severity", "technique_id").alias("line"))
    notes = comments.select("case_id", F.lit(6).alias("section"), "ord", F.format_string(
        "- **%s** (%s): %s", "author", _stamp(F.col("ts")), "body").alias("line"))
    parts = [header, summary, advice,
             titles(found, 3, ["", "## Evidence", "", "| Time | Rule | Severity | Technique |", "|---|---|---|---|"]),
             table, titles(comments, 5, ["", "## Notes", ""]), notes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def render_report(lines: DataFrame, case_id: str) -> DataFrame:
    """One case's lines in reading order; write with ``sources.sinks`` or show."""
    return lines.filter(F.col("case_id") == case_id).orderBy("section", "ord").select("line")
