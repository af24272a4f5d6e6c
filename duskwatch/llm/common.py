"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table (a few longs each, so tens of MB) up to which it is sent to every executor.
SEND_ROWS = 500_000
#: Texts per Arrow batch: long texts then stay within a worker's memory.
BATCH_ROWS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch, since a row here is a whole text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def sendable(df: DataFrame, rows: int = SEND_ROWS) -> DataFrame:
    """``df`` (a saved table) with a broadcast hint if it has at most ``rows`` rows, else as it is: Spark then
    shuffles both sides and splits skewed partitions."""
    return F.broadcast(df) if df.count() <= rows else df


def packed(docs: DataFrame, *columns: str | Column, apart: str | None = None) -> DataFrame:
    """``docs`` as one struct ``_row`` with the named columns beside it, so no other column can clash with an operator's
    own. A column ``apart`` is only beside it, and has to be given back to ``unpacked``."""
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != apart))
    return docs.select(row.alias("_row"), *columns, *([apart] if apart else []))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``_row``, those named in ``new`` replaced, then the rest of ``new``."""
    own = [new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in columns]
    return rows.select(*own, *(v.alias(c) for c, v in new.items() if c not in columns))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """Words between white space; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE), "")


def chunks(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        here = len(text or b"")
        if i > start and size + here > limit:
            yield start, i
            start, size = i, 0
        size += here
    if start < len(texts):
        yield start, len(texts)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def without_space(c: Column) -> Column:
    """The characters of words alone."""
    return F.translate(c, " \t\n\x0b\x0c\r", "")


def has_word(c: Column) -> Column:
    return F.octet_length(without_space(c)) > 0
