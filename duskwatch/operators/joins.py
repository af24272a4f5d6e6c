"""Joins of a large, possibly skewed side with a lookup side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16


def row_salt(df: DataFrame, salts: int, exclude: list[str] = ()) -> Column | None:
    """A salt from the row's own values, so a recomputed task yields the same salt."""
    names = ["seq"] if "seq" in df.columns else [
        f.name for f in df.schema.fields
        if f.name not in exclude and isinstance(f.dataType, (T.StringType, T.NumericType, T.TimestampType))]
    return F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int") if names else None


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """Join rows to a lookup that is unique per key, whatever the skew of the left side.

    The right side is replicated once per salt and the left side spreads over the salts,
    so a key holding a third of the rows lands on ``salts`` tasks.  No broadcast is
    forced: Spark itself broadcasts the replicated side when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    salt = row_salt(left, salts, on)
    if salt is None:
        return left.join(right, on, how)
    # A null key matches nothing: such rows get numbers no lookup row has and spread over all tasks.
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    salt = F.when(absent, -1 - row_salt(left, 1 << 30, on)).otherwise(salt)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")
