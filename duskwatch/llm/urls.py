"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host and a path (``host/path``). It fits its host and all subdomains if the URL's
path starts with the rule's. Every distinct (host, path) of the URLs is expanded into its host
suffixes times its path prefixes (of the lengths that rules have); expressions meet rules on the
first four bytes of their SHA-256, the full digests confirm, and the longest rule wins (the
longer host between equals; block before allow between equal rules). Equal URLs are expanded once.

Defined cases: null URLs and URLs without ``://`` have an empty host and path and fit no rule;
what fits no rule gets ``default``; null rules and verdicts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, packed, unpacked



def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\x00"), path), 256))


def _short(digest: Column) -> Column:
    """The first four bytes as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """(short, digest, rule, r_host, r_path, verdict), one row for each distinct rule, of rows (host, path, verdict)."""
    own = rules.filter("host is not null and path is not null and verdict is not null") \
        .groupBy(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return own.select(_short(digest).alias("short"), digest.alias("digest"), F.concat("r_host", "r_path").alias("rule"), "r_host", "r_path", "verdict")


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, short, digest): host suffixes times path prefixes of the given lengths."""
    labels = F.split("host", r"\.")
    suffixes = let(labels, lambda l: F.transform(F.sequence(F.lit(1), F.size(l)), lambda i: F.array_join(F.slice(l, i, F.size(l)), ".")))
    fits = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path"))
    wide = urls.withColumn("_host", F.explode(suffixes)).withColumn("_path", F.explode(F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))))
    digest = _digest(F.col("_host"), F.col("_path"))
    return wide.select("host", "path", _short(digest).alias("short"), digest.alias("digest"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict, in place of such columns of ``pages``."""
    named = packed(pages, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    table = rule_table(rules)
    # One row for each length that paths of rules have: a few numbers.
    lengths = sorted(r[0] for r in table.select(F.length("r_path")).distinct().collect()) or [0]
    known = expressions(named.select("host", "path").distinct(), lengths).join(table.withColumnRenamed("digest", "full"), "short") \
        .filter(F.col("digest") == F.col("full"))
    best = known.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), "verdict", "rule")).alias("best")) \
        .select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", F.col("best.verdict").alias("_verdict"))
    joined = named.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return unpacked(joined, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"),
                    verdict=F.coalesce("_verdict", F.lit(default)))
