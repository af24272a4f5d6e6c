"""Rules and indicators over events: one alert row per (event, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEVERITY_RANK, rank_of
from .rule_index import exploded

#: Rules whose table (a few hundred bytes each) goes to every executor.
SENT_RULES = 50_000

TECHNIQUE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "tactic")])
RULE = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("risk_score", T.IntegerType()),
    T.StructField("response", T.StringType()), T.StructField("technique", TECHNIQUE),
])


def rule_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The rule metadata as a table, one row per rule in evaluation order."""
    rows = [(i, r["id"], r["name"], r["description"], r["severity"], r["risk_score"], r["response"],
             (r["technique"]["id"], r["technique"]["name"], r["technique"]["tactic"]))
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


def detect(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Every rule against every event: event columns plus a ``rule`` struct.

    One narrow pass, then a join with the rule list, which the caller holds on the driver.
    """
    spark = df.sparkSession
    if not rules:
        return df.withColumn("rule", F.lit(None).cast(RULE)).filter(F.lit(False))
    meta = rule_frame(spark, rules)
    meta = meta.select(F.col("ord").alias("_rule"), F.struct(*meta.columns).alias("rule"))
    return exploded(df, rules).join(F.broadcast(meta) if len(rules) <= SENT_RULES else meta, "_rule").drop("_rule")


def alert_risk(rule: str = "rule") -> Column:
    """An alert's own score, else the fixed score of its severity."""
    # Severity -> default risk.
    rank = rank_of(F.col(f"{rule}.severity"), {"low": 10, "medium": 25, "high": 50, "critical": 80})
    own = F.coalesce(F.col(f"{rule}.risk_score"), F.lit(0))
    return F.when(own > 0, own).otherwise(rank)


def severity_for_risk(risk: Column) -> Column:
    return (F.when(risk >= 90, "critical").when(risk >= 75, "high")
            .when(risk >= 50, "medium").otherwise("low"))


def severity_rank(column: Column) -> Column:
    return rank_of(column, SEVERITY_RANK)


def intel_alerts(hits: DataFrame) -> DataFrame:
    """Indicator hits (event columns plus an ``ioc`` struct) as alerts."""
    network = F.col("ioc.type").isin("ip", "domain")
    text = lambda value: F.when(network, F.lit(value)).otherwise(F.lit(""))
    rule = F.struct(
        (F.lit(1_000_000) + F.col("ioc.probe")).cast("int").alias("ord"),
        F.concat(F.lit("INTEL-"), F.upper("ioc.type")).alias("id"),
        F.lit("Threat intel match").alias("name"),
        F.format_string('%s "%s" matched an indicator from feed %s', F.col("ioc.field"),
                        F.col("ioc.indicator"), F.col("ioc.source")).alias("description"),
        F.lit("high").alias("severity"), F.lit(60).alias("risk_score"), F.lit("").alias("response"),
        F.struct(text("T1071").alias("id"), text("Application Layer Protocol").alias("name"),
                 text("command-and-control").alias("tactic")).alias("technique"),
    )
    return hits.withColumn("rule", rule).drop("ioc")


def detect_all(df: DataFrame, rules: list[dict], iocs: DataFrame | None = None) -> DataFrame:
    """Rule alerts and, when a feed is given, indicator alerts."""
    alerts = detect(df, rules)
    if iocs is None:
        return alerts
    from .intel import match_indicators

    return alerts.unionByName(intel_alerts(match_indicators(df, iocs)))
