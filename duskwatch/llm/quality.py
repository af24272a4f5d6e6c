"""Quality rules, lines first: failing lines are removed, then documents that lose too much go.

A line with words fails by
- punctuation: more than 1 in 20 of its characters is a symbol, or it is short and has no
  closing punctuation;
- navigation: two or more separators between entries;
- boilerplate: a phrase of page furniture.

A document is rejected if its base figures fail (too few words, too much repetition), or if the
failing lines hold more than ``LOSS`` percent of its characters of words.

Defined cases: null, empty and wordless texts have no words and are rejected; every row is
judged on its own, so repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_word, let, packed, split_words, unpacked, without_space

MIN_WORDS = 10
MAX_REPEATED = 20
LOSS = 40
#: Symbols of the base figures, and those that a line may hold few of.
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&|<>{}[]=~^_\\!"
SEPARATORS = "|»›•·"
#: Lines of fewer characters of words need closing punctuation.
SHORT = 30
CLOSING = r"[.!?:;,…\)\]\"'”»。]$"
BOILERPLATE = ("javascript", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved",
               "click here", "sign up for", "subscribe to our", "share this", "read more", "lorem ipsum")
WINDOW = 5


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that the text has twice or more."""
    def of(words):
        keys = F.transform(words, lambda w: F.xxhash64(w))
        return let(keys, lambda k: let(F.transform(
            F.sequence(F.lit(0), F.size(k) - window), lambda i: F.xxhash64(*(F.get(k, i + j) for j in range(window)))), covered))

    def covered(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def starts(s):
            twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))
        total = F.aggregate(let(ordered, starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct(
            (a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    return F.when(F.size(words) > window, of(words)).otherwise(F.lit(0))


def line_fails(line: Column) -> Column:
    """Whether a line that has words is removed."""
    own = F.length(without_space(line))
    symbols = 20 * _count(line, LINE_SYMBOLS) > F.length(line)
    bare = (own < SHORT) & ~F.rtrim(line).rlike(CLOSING)
    navigation = _count(line, SEPARATORS) >= 2
    return symbols | bare | navigation | F.lower(line).rlike("|".join(BOILERPLATE))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the base figures, ``cleaned`` (its text without failing lines), lost_chars, base_failed and kept
    (in place of such columns of ``docs``)."""
    text = F.coalesce("text", F.lit(""))
    out = packed(docs, apart="text").withColumn("_words", split_words(text)).withColumn("_lines", F.filter(F.split(text, "\n"), has_word)) \
        .withColumn("_good", F.filter("_lines", lambda l: ~line_fails(l)))
    word_chars = F.length(without_space(text))
    good_chars = F.length(without_space(F.array_join("_good", "")))
    out = out.select(
        "_row", "text", F.size("_words").cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.array_join("_good", "\n").alias("cleaned"), (word_chars - good_chars).cast("long").alias("lost_chars"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    new = {c: F.col(c) for c in out.columns if c != "_row"}
    kept = ~failed & (100 * F.col("lost_chars") <= LOSS * F.col("word_chars"))
    return unpacked(out, docs.columns, **new, base_failed=failed, kept=kept)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with failing lines removed from ``text``."""
    return unpacked(judge(packed(docs, apart="text")).filter("kept"), docs.columns, text=F.col("cleaned"))
