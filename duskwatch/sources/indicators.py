"""Indicator feeds: one value per text line, type inferred, ``#`` starts a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import ip_hex, parse_cidr


def classify(lines: DataFrame) -> DataFrame:
    """(type, value, source, ord) from (value, source, ord); malformed networks are dropped.

    ``ord`` is the feed order: it decides the winner among networks and duplicates.
    """
    text = F.trim(F.substring_index("value", "#", 1))
    rows = lines.select(text.alias("raw"), "source", "ord").filter("raw <> ''")
    kind = (F.when(F.col("raw").contains("/"), "cidr").when(ip_hex(F.col("raw")).isNotNull(), "ip")
            .when(F.col("raw").rlike(r"\A[0-9A-Fa-f]{64}\z"), "hash").otherwise("domain"))
    # A one-element explode hands on finished columns, so later joins and filters do not
    # copy the parsing expressions into their own conditions.
    facts = F.struct(kind.alias("type"), parse_cidr(F.col("raw")).isNotNull().alias("is_net"))
    typed = rows.withColumn("t", F.explode(F.array(facts)))
    value = F.when(F.col("t.type").isin("domain", "hash"), F.lower("raw")).otherwise(F.col("raw"))
    return (typed.filter((F.col("t.type") != "cidr") | F.col("t.is_net"))
            .select("t.type", value.alias("value"), "source", "ord"))


def read_indicators(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Feeds in the given order; the source of an indicator is its file name."""
    frames = []
    for number, path in enumerate(paths):
        # Ids grow with line position; the feed number comes first.
        place = F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 52)
        frames.append(spark.read.text(path).select(
            "value", F.col("_metadata.file_name").alias("source"), place.alias("ord")))
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return classify(lines)
