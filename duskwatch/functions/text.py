"""Byte-level text measures without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes in bits; 0 for an empty string."""
    code = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    marks = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(code, i * 2 - 1, F.lit(2)))
    terms = F.transform(
        F.array_distinct(marks),
        lambda b: (F.size(F.filter(marks, lambda m: m == b)) / n))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(total)


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def path_depth(path: Column) -> Column:
    text = F.coalesce(path, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))
