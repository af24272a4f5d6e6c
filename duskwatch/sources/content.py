"""Static file content for hashing and signature scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_content(spark: SparkSession, glob: str, max_bytes: int | None = None) -> DataFrame:
    """(path, length, content): whole files.

    With ``max_bytes`` the bytes of longer files are not read: such a file is a row without
    content, so a caller sees what was skipped.
    """
    raw = spark.read.format("binaryFile").load(glob)
    path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "").alias("path")
    if max_bytes is None:
        return raw.select(path, "length", "content")
    read = raw.filter(F.col("length") <= max_bytes).select(path, "length", "content")
    skipped = raw.filter(F.col("length") > max_bytes).select(path, "length", F.lit(None).cast("binary").alias("content"))
    return read.union(skipped)
