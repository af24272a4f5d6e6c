"""Benchmark decontamination: a prefix-filtered set join of item windows with document shingles.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window); a
window is the ordered set of its word shingles. Documents and windows meet in four steps:

1. one pass over the documents keeps the runs of consecutive shingles that some window has
   (a run shorter than the shortest window is dropped: the length bound);
2. the shingles are ordered by how often all documents have them, rarest first; a window with a
   shingle that no document has cannot occur;
3. a window is contained only if all its shingles are, so its necessary prefix is one shingle,
   the rarest: runs and prefixes are joined on it, and the shingle's place in the window gives
   the only possible start, which must lie inside the run (positional bound);
4. the run is compared with the whole window, shingle by shingle.

Windows are dealt into blocks of bounded bytes. A block's words and shingles are sent to the
executors; a benchmark of any size is a number of blocks, each one pass over the documents.

Defined cases: null and wordless texts have no words; items without id, text or words are
ignored; repeated items and documents are allowed, each input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf
from .common import chunks, lower_ascii, packed, sendable, small_batches, unpacked

#: Words, after lower-casing A-Z: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Bytes of windows in one block: with their dictionaries some 100 MB in a worker.
BLOCK_BYTES = 8 << 20
RUNS = "doc_id long, text_key long, n_words long, runs array<struct<start:int,shingles:array<int>>>"
#: A-Z to a-z, digits and a-z kept, all other ASCII to spaces, bytes of longer characters kept.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win): the distinct windows of every item, words joined by a space."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), GAP), "")
    items = benchmark.filter("item_id is not null").select("item_id", words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    return items.select("item_id", F.explode(F.array_distinct(cut)).alias("win")).distinct()


class _Block:
    """The words and shingles of one block of windows, as sent to the executors."""

    def __init__(self, windows: list[bytes]) -> None:
        split = [w.split() for w in windows]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
        keys = [self._keys(np.array([self.vocabulary[w] for w in ws], np.int64)) for ws in split]
        # By shingle size (a window of fewer words than a shingle is one shingle): its sorted keys.
        self.sizes = {}
        place, base = {}, 0
        for size in sorted({s for s, _ in keys}):
            own = np.unique(np.concatenate([k for s, k in keys if s == size]))
            self.sizes[size] = (own, base, min(len(k) for s, k in keys if s == size))
            place[size], base = (own, base), base + len(own)
        self.shingles = [(np.searchsorted(place[s][0], k) + place[s][1]).tolist() for s, k in keys]

    @staticmethod
    def pack(ids: np.ndarray, size: int) -> np.ndarray:
        """One exact number for each ``size`` consecutive word numbers (21 bits each)."""
        n = max(0, len(ids) - size + 1)
        out = np.zeros(n, np.int64)
        for j in range(size):
            out = (out << 21) | ids[j : j + n]
        return out

    @classmethod
    def _keys(cls, ids: np.ndarray) -> tuple[int, np.ndarray]:
        size = min(SHINGLE, len(ids))
        return size, cls.pack(ids, size)


def _document_runs(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = sent.value
        number = block.vocabulary.get
        kind = pa.list_(pa.struct([("start", pa.int32()), ("shingles", pa.list_(pa.int32()))]))
        for batch in batches:
            texts = batch.column("body").to_pylist()
            counts, found = [0] * len(texts), [[] for _ in texts]
            for lo, hi in chunks(texts):
                ids, begin = [], []
                for k in range(lo, hi):
                    words = (texts[k] or b"").translate(FOLD).split()
                    counts[k] = len(words)
                    begin.append(len(ids))
                    ids += [number(w, 0) for w in words]
                    ids.append(0)  # no shingle spans two documents
                begin, ids = np.array(begin), np.array(ids, np.int64)
                for size, (keys, base, least) in block.sizes.items():
                    known = ids[: len(ids) - size + 1] > 0
                    for j in range(1, size):
                        known = known & (ids[j : len(ids) - size + 1 + j] > 0)
                    at = np.flatnonzero(known)
                    key = np.zeros(len(at), np.int64)
                    for j in range(size):
                        key = (key << 21) | ids[at + j]
                    spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[spot] == key
                    at, spot = at[hit], spot[hit] + base
                    edges = np.flatnonzero(np.diff(at) != 1) + 1
                    for a, b in pairwise([0, *edges.tolist(), len(at)]):
                        if b - a >= least:
                            k = int(np.searchsorted(begin, at[a], "right")) - 1
                            found[lo + k].append({"start": int(at[a] - begin[k]), "shingles": spot[a:b].astype(np.int32)})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(found, kind)],
                names=["doc_id", "text_key", "n_words", "runs"])

    return run


def _block_hits(runs: DataFrame, block: _Block, windows: list[str]) -> DataFrame:
    """(doc_id, text_key, start, words, win): every occurrence of every window of the block."""
    spark = runs.sparkSession
    listed = spark.createDataFrame([(w, len(w.split(" ")), s) for w, s in zip(windows, block.shingles)],
                                   "win string, words int, own array<int>")
    rows = runs.select("doc_id", "text_key", F.explode("runs").alias("run")) \
        .select("doc_id", "text_key", F.col("run.start").alias("first"), F.col("run.shingles").alias("seen"))
    rarity = rows.select(F.explode("seen").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    each = listed.select("win", "words", "own", F.posexplode("own").alias("offset", "shingle"))
    # Rarest first, the number breaks ties. The window list is one block, so it and its joins stay small.
    prefix = each.join(rarity, "shingle").groupBy("win", "words", "own").agg(
        F.count("*").alias("found"), F.min(F.struct("n", "shingle", "offset")).alias("rarest")) \
        .filter(F.col("found") == F.size("own")) \
        .select("win", "words", "own", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    tokens = rows.select("doc_id", "text_key", "first", "seen", F.posexplode("seen").alias("pos", "shingle"))
    at = F.col("pos") - F.col("offset")
    return tokens.join(F.broadcast(prefix), "shingle") \
        .filter((at >= 0) & (at + F.size("own") <= F.size("seen"))) \
        .filter(F.slice("seen", at + 1, F.size("own")) == F.col("own")) \
        .select("doc_id", "text_key", (F.col("first") + at).alias("start"), "words", "win")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words) of every row, and (doc_id, text_key, start, words, item_id) of every
    window that occurs; both are saved tables. ``text_key`` tells apart rows that share a doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    shelf = Shelf(spark)
    owned = shelf.save(item_windows(benchmark, window), "windows")
    size = owned.agg(F.sum(F.octet_length("win"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    body = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("body"))
    counts = hits = None
    for b in range(blocks):
        # At most about BLOCK_BYTES, whatever the size of the benchmark.
        own = owned.select("win").distinct().filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        windows = sorted(r.win for r in own.collect())
        block = _Block([w.encode() for w in windows])
        sent = spark.sparkContext.broadcast(block)
        runs = shelf.save(body.mapInArrow(_document_runs(sent), RUNS), f"runs-{b}")
        found = shelf.save(_block_hits(runs, block, windows), f"hits-{b}") if windows else None
        counts = runs.drop("runs") if counts is None else counts
        if found is not None:
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "doc_id long, text_key long, start int, words int, win string")
    return counts, hits.join(owned, "win").drop("win")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: n_words, hit word spans (start, end), the items that occur, and n_hit."""
    counts, hits = occurrences(docs, benchmark, window)
    marks = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("words")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.end))).cast("long").alias("n"),
                              F.greatest(a.end, s.end).alias("end")), lambda a: a.n)
    marks = marks.select("doc_id", "text_key", "spans", "items", covered.alias("n_hit"))
    none = F.array().cast("array<string>")
    left, right = counts.alias("c"), marks.alias("m")
    return left.join(right, F.col("c.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("c.text_key").eqNullSafe(F.col("m.text_key")), "left") \
        .select("c.doc_id", "c.text_key", "c.n_words", "m.spans", F.coalesce("m.items", none).alias("items"),
                F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    _, hits = occurrences(docs, benchmark, window)
    bad = Shelf(docs.sparkSession).save(hits.select("doc_id", "text_key").distinct(), "contaminated")
    rows = packed(docs, "doc_id", F.xxhash64("text").alias("text_key")).alias("d")
    match = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_key") == F.col("b.text_key"))
    return unpacked(rows.join(sendable(bad).alias("b"), match, "left_anti"), docs.columns)
