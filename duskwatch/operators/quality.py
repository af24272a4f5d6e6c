"""Coverage of the rule set and the quality of its detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import detect

# Tactics in kill-chain order.
TACTIC_ORDER = ("initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
                "credential-access", "discovery", "lateral-movement", "collection", "command-and-control",
                "exfiltration", "impact")


def coverage_layer(rules: DataFrame) -> DataFrame:
    """Per technique: number of rules, sorted ids, comment and the scale's maximum (at least 1)."""
    per = (rules.filter(F.coalesce(F.col("technique.id"), F.lit("")) != "")
           .groupBy(F.col("technique.id").alias("technique_id"))
           .agg(F.count("*").alias("score"), F.array_sort(F.collect_list("id")).alias("rule_ids")))
    # One row per technique of the rule table: a small, bounded window.
    top = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1))
    comment = F.concat(F.col("score").cast("string"), F.lit(" rule(s): "), F.array_join("rule_ids", ", "))
    return per.select("technique_id", "score", comment.alias("comment"), top.alias("max_score"))


def tactic_matrix(rules: DataFrame) -> DataFrame:
    """Counts by tactic and technique, kill-chain position and shade 0.25 .. 1."""
    tactic = F.coalesce(F.nullif("technique.tactic", F.lit("")), F.lit("uncategorized"))
    technique = F.coalesce(F.nullif("technique.id", F.lit("")), F.lit("—"))
    per = rules.groupBy(tactic.alias("tactic"), technique.alias("technique_id")).agg(F.count("*").alias("n"))
    top = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))
    position = F.array_position(F.array(*[F.lit(t) for t in TACTIC_ORDER]), F.col("tactic")) - 1
    return per.select(
        "tactic", "technique_id", "n", F.when(position < 0, 99).otherwise(position).cast("int").alias("position"),
        (0.25 + 0.75 * F.col("n") / top).alias("shade"))


def test_outcomes(rules: list[dict], fixtures: DataFrame) -> DataFrame:
    """(name, rule, expect, known, fired, passed) per test.

    ``fixtures`` has name, rule, expect and event columns, one row per event of a test.
    """
    known = [r["id"] for r in rules]
    tests = fixtures.groupBy("name").agg(F.max("test_rule").alias("rule"), F.max("expect").alias("expect"))
    fired = (detect(fixtures, rules).filter(F.col("rule.id") == F.col("test_rule"))
             .groupBy("name").agg(F.lit(True).alias("fired")))
    joined = tests.join(fired, "name", "left").withColumns({
        "fired": F.coalesce("fired", F.lit(False)), "known": F.col("rule").isin(known) if known else F.lit(False)})
    passed = F.col("known") & (F.col("fired") == (F.col("expect") == "fire"))
    return joined.select("name", "rule", "expect", "known", "fired", passed.alias("passed"))


def quality_gate(report: DataFrame, max_false_positive_rate: float = 0.0, untested_ok: bool = True) -> DataFrame:
    """Add ``ok``: no missed test, false positives within the rate and, if asked, no rule without a test."""
    ok = (F.col("false_negatives") == 0) & (F.col("false_positive_rate") <= max_false_positive_rate)
    return report.withColumn("ok", ok if untested_ok else ok & (F.size("untested") == 0))


def rule_quality(rules: list[dict], fixtures: DataFrame) -> DataFrame:
    """One row: totals, false positives / negatives, FP rate over no-fire tests, untested rules."""
    outcomes = test_outcomes(rules, fixtures)
    quiet = F.col("expect") == "no-fire"
    totals = outcomes.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed") & quiet).alias("false_positives"),
        F.count_if(~F.col("passed") & ~quiet).alias("false_negatives"), F.count_if(quiet).alias("quiet"),
        F.collect_set(F.when(F.col("known"), F.col("rule"))).alias("tested"))
    rate = F.when(F.col("quiet") == 0, F.lit(0.0)).otherwise(F.col("false_positives") / F.col("quiet"))
    every = F.array(*[F.lit(r["id"]) for r in rules]) if rules else F.array().cast("array<string>")
    return totals.select("total", "passed", "false_positives", "false_negatives",
                         rate.alias("false_positive_rate"),
                         F.array_sort(F.array_except(every, "tested")).alias("untested"))
