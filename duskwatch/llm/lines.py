"""Line dedup: overlapping three-line windows that repeat anywhere in the corpus.

Every three consecutive lines of a document that have words (blank lines between them don't
count) make a window, known by two 64-bit hashes. A window's first occurrence, by (doc_id, text
hash, line), stays; every later one is removed: the covered lines of a document, from the
windows' first to last lines, are merged and cut out. A window that repeats within one document
is treated alike.

Defined cases: null and empty texts and documents of fewer than three lines with words have no
window and stay as they are; a row without doc_id comes before all others; rows equal in doc_id
and text count as one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf
from .common import has_word, let, packed, unpacked

WINDOW = 3
SEND_NUMBERS = 2_000_000


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, key_a, key_b, start, end): every window with its first and last line number."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.struct(i.alias("at"), l.alias("l")))
    full = F.transform(F.filter(lines, lambda s: has_word(s.l)),
                       lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["l"]).alias("a"), F.xxhash64(F.lit(1), s["l"]).alias("b")))

    def cut(full):
        def one(i):
            own = [F.get(full, i + k) for k in range(window)]
            return F.struct(F.xxhash64(*(o["a"] for o in own)).alias("key_a"), F.xxhash64(*(o["b"] for o in own)).alias("key_b"),
                            own[0]["at"].alias("start"), own[-1]["at"].alias("end"))

        return F.when(F.size(full) >= window, F.transform(F.sequence(F.lit(0), F.size(full) - window), one))

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(let(full, cut)).alias("w")).select("doc_id", "text_key", "w.*")


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, gone): the line numbers that later occurrences cover, of documents that have such; a saved table."""
    shelf = Shelf(docs.sparkSession)
    seen = shelf.save(windows(docs, window), "windows")
    place = F.struct("doc_id", "text_key", "start")
    first = seen.groupBy("key_a", "key_b").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = seen.join(first, ["key_a", "key_b"]).filter(place != F.col("first"))
    spans = later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.end))))
    return shelf.save(spans.select("doc_id", "text_key", gone.alias("gone")), "gone")


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with later occurrences cut out of ``text``, and the columns n_lines and n_removed (in place of such columns of ``docs``)."""
    gone = repeated_lines(docs, window)
    # Its size in numbers decides whether it is sent to the executors (some 16 MB) or shuffled with the texts.
    numbers = gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    gone = (F.broadcast(gone) if numbers <= SEND_NUMBERS else gone).alias("g")
    rows = packed(docs, "doc_id", F.xxhash64("text").alias("text_key"), apart="text").alias("d")
    match = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    cut = let(F.split("d.text", "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.gone")), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(cut)
    return unpacked(rows.join(gone, match, "left"), docs.columns, text=text,
                    n_lines=F.coalesce(F.array_size(F.split("d.text", "\n")), F.lit(0)).cast("long"),
                    n_removed=F.coalesce(F.array_size("g.gone"), F.lit(0)).cast("long"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` alone, without documents of which nothing is left."""
    cut = dedup_lines(packed(docs, "doc_id", apart="text"), window).filter((F.col("n_removed") == 0) | has_word(F.col("text")))
    return unpacked(cut, docs.columns, text=F.col("text"))
