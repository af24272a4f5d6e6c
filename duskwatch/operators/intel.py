"""Indicator matching: exact keys and network ranges as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ip import ip_family, ip_hex, ip_prefix, parse_cidr
from .joins import lookup_join


def join_cidr(df: DataFrame, ip: str, nets: DataFrame, out: str = "net") -> DataFrame:
    """Left-join the first network (lowest ``ord``) that contains an address column.

    ``nets`` has ``cidr`` and ``ord`` plus payload.  A range test becomes an equi-join:
    each address is probed once per distinct prefix length in the feed (at most 33 for
    v4, 129 for v6), so no pair of rows is compared that shares no prefix.
    The result is one row per input row, so the distinct addresses are resolved first.
    """
    parsed = nets.withColumn("_net", F.explode(F.array(parse_cidr(F.col("cidr"))))).filter("_net is not null").select("*", "_net.*")
    payload = F.struct(*[F.col(c) for c in nets.columns])
    first = parsed.groupBy("net_family", "net_bits", "net_prefix").agg(
        F.min(F.struct("ord", payload.alias("net"))).alias("best"))
    # At most 33 + 129 integers, whatever the feed's size.
    lengths = (first.groupBy("net_family")
               .agg(F.array_sort(F.collect_set("net_bits")).alias("net_lengths")))
    addresses = (df.select(F.col(ip).alias("_ip")).filter(F.col("_ip").isNotNull()).distinct()
                 .withColumn("_hex", F.explode(F.array(ip_hex(F.col("_ip"))))).filter("_hex is not null")
                 .withColumn("net_family", ip_family(F.col("_hex"))))
    probes = (addresses.join(lengths, "net_family")
              .select("_ip", "_hex", "net_family", F.explode("net_lengths").alias("net_bits"))
              .withColumn("net_prefix", ip_prefix(F.col("_hex"), F.col("net_bits"))))
    found = (lookup_join(probes, first, ["net_family", "net_bits", "net_prefix"], "inner")
             .groupBy("_ip").agg(F.min("best").alias("best"))
             .select("_ip", F.col("best.net").alias(out)))
    return lookup_join(df.withColumn("_ip", F.col(ip)), found, ["_ip"], "left").drop("_ip")


def match_indicators(df: DataFrame, iocs: DataFrame) -> DataFrame:
    """At most one hit per probe (destination ip, source ip, domain, hash) of an event.

    ``iocs`` comes from ``sources.indicators`` (type, value, source, ord).  An exact ip
    beats any network; among networks the first in feed order wins.
    """
    clean = lambda c: F.nullif(c, F.lit(""))
    probe = lambda n, field, kind, path: F.struct(
        F.lit(n).alias("probe"), F.lit(field).alias("field"), F.lit(kind).alias("type"),
        clean(F.col(path)).alias("indicator"),
        (clean(F.col(path)) if kind == "ip" else F.lower(clean(F.col(path)))).alias("key"))
    probes = F.array(probe(0, "destination.ip", "ip", "network.dst_ip"), probe(1, "source.ip", "ip", "network.src_ip"),
                     probe(2, "network.domain", "domain", "network.domain"),
                     probe(3, "process.sha256", "hash", "process.sha256"))
    # Only distinct probe values meet the feed; matched values are then looked up per event.
    keys = (df.select(F.explode(probes).alias("p")).filter("p.key is not null")
            .select(F.col("p.type").alias("type"), F.col("p.key").alias("key")).distinct())
    exact = (iocs.filter("type in ('ip', 'domain', 'hash')")
             .groupBy("type", F.col("value").alias("key")).agg(F.max_by("source", "ord").alias("source")))
    direct = keys.join(exact, ["type", "key"])
    nets = iocs.filter("type = 'cidr'").select(F.col("value").alias("cidr"), "ord", "source")
    unknown = keys.filter("type = 'ip'").join(exact, ["type", "key"], "left_anti")
    ranged = (join_cidr(unknown, "key", nets).filter("net is not null")
              .select("type", "key", F.col("net.source").alias("source")))
    known = direct.unionByName(ranged)
    exploded = df.withColumn("_p", F.explode(probes)).filter("_p.key is not null") \
        .withColumns({"_type": F.col("_p.type"), "_key": F.col("_p.key")})
    hits = lookup_join(exploded, known.toDF("_type", "_key", "_source"), ["_type", "_key"], "inner")
    ioc = F.struct(F.col("_p.probe").alias("probe"), F.col("_p.indicator").alias("indicator"),
                   F.col("_type").alias("type"), F.col("_p.field").alias("field"), F.col("_source").alias("source"))
    return hits.withColumn("ioc", ioc).drop("_p", "_type", "_key", "_source")
