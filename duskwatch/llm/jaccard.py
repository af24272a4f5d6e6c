"""N-gram Jaccard join: a grouped prefix join of documents' word-shingle sets.

The shingles of all documents have one order: by number, but shingles that many documents
share come last, by how many. In that order two sets of similarity t share one of their first
``n - ceil(t n) + 1`` shingles, the prefix.

1. A pass over the texts finds the frequent shingles (an ordering hint of bounded size: results
   don't depend on it).
2. A pass over the texts gives each document its set size, set key and prefix. Documents with
   the same prefix and size are one group.
3. Groups that share a prefix shingle are candidates. A shingle of few groups gives pairs, which
   pass the size filter and the overlap bound (what the prefixes share, plus all that is left,
   must reach the needed overlap). A shingle of many groups is cut by size; a size cell that is
   still crowded ties its groups to its smallest, so no shingle gives more rows than a multiple
   of its groups.
4. Candidate groups are expanded into their distinct sets. Connected candidates are verified
   block by block: every pair of sets within a block pair is compared exactly, and the block
   pair returns a spanning forest of its links, not the links.

So equal sets are one class, and classes are linked by forests: no link between different texts
is lost for components, and no group of copies is expanded into pairs.

Defined cases: null and wordless texts have an empty set and link with nothing; rows without
doc_id link with nothing and have no component; repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf
from .common import chunks, packed, sendable, small_batches, unpacked
from .components import components
from .grams import shingle_sets

#: The ordering hint: at most this many frequent shingles are sent to the executors (4 MB).
HINT = 1 << 18
#: A shingle is counted for the hint where this many of about HINT_TOKENS shingles in a row are equal to it.
HINT_LEAST, HINT_TOKENS = 4, 1 << 21
#: Groups that share a prefix shingle up to which all their pairs are candidates; likewise of one size band.
PAIRS, CELL_PAIRS = 48, 96
#: Sets and shingles in a block of the verification.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("body"))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = [t or b"" for t in batch.column("body").to_pylist()]
    for lo, hi in chunks(texts):
        yield from enumerate(shingle_sets(texts[lo:hi], size), lo)


def _set_key(tokens: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist()


def _frequent(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            own = n >= HINT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(token[own].view(np.int64)), pa.array(n[own])], names=["token", "n"])

        held, total = [], 0
        for batch in batches:
            for _, tokens in _sets(batch, size):
                held.append(tokens)
                total += len(tokens)
                if total >= HINT_TOKENS:
                    yield counted(held)
                    held, total = [], 0
        if held:
            yield counted(held)

    return run


def _hint(docs: DataFrame, size: int, shelf: Shelf) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the rank of each by frequency; at most HINT of them."""
    counts = _bodies(docs).select("body").mapInArrow(_frequent(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = shelf.save(counts, "frequent")
    # A histogram of a few dozen rows tells the count from which on there are at most HINT.
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in steps:
        total += row["count"]
        if total > HINT:
            break
        least = row["step"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.filter(F.floor(F.log2("n") * 4) >= least).toPandas()
    token, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def _prefix(tokens: np.ndarray, length: int, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``length`` shingles: infrequent ones by number, then frequent ones by rank."""
    if not len(hot):
        return tokens[:length]
    look = length
    while True:
        own = tokens[:look]
        spot = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        frequent = hot[spot] == own
        if look >= len(tokens) or look - np.count_nonzero(frequent) >= length:
            break
        look *= 2
    cold = own[~frequent][:length]
    if len(cold) < length:
        late = own[frequent]
        cold = np.concatenate([cold, late[np.argsort(rank[spot[frequent]])][: length - len(cold)]])
    return cold


def _prefixes(size: int, percent: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = sent.value
        for batch in batches:
            n, key_a, key_b, grp, prefixes = ([None] * batch.num_rows for _ in range(5))
            for k, tokens in _sets(batch, size):
                n[k] = len(tokens)
                if len(tokens):
                    own = _prefix(tokens, len(tokens) - needed(len(tokens), percent) + 1, hot, rank)
                    key_a[k], key_b[k] = _set_key(tokens)
                    grp[k] = _set_key(own)[0]
                    prefixes[k] = own.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *(pa.array(x, pa.int64()) for x in (n, key_a, key_b, grp)),
                 pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "key_a", "key_b", "grp", "prefix"])

    return run


def _expanded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("key_a").to_pylist(), batch.column("key_b").to_pylist()))
            own = [(k, t) for k, t in _sets(batch, size) if tuple(_set_key(t)) == keys[k]]
            at = pa.array([k for k, _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("root").take(at), batch.column("blocks").take(at),
                 pa.array([t.tobytes() for _, t in own], pa.binary())], names=["doc_id", "root", "blocks", "tokens"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every pair of sets."""
    count = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(count), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    df = np.diff(np.r_[begin, len(tokens)])
    out = np.zeros((count, count), np.int64)
    rare = 12
    for d in range(2, rare):  # shingles of few sets: their pairs
        at = begin[df == d]
        if len(at):
            held = owner[at[:, None] + np.arange(d)]
            i, j = np.triu_indices(d, 1)
            out += np.bincount((held[:, i] * count + held[:, j]).ravel(), minlength=count * count).reshape(count, count)
    at, length = begin[df >= rare], df[df >= rare]
    for c in range(0, len(at), 4096):  # shingles of many sets: a matrix product
        a, n = at[c : c + 4096], length[c : c + 4096]
        column = np.repeat(np.arange(len(a)), n)
        place = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        held = np.zeros((count, len(a)), np.float32)
        held[owner[place], column] = 1
        out += np.triu(held @ held.T, 1).astype(np.int64)
    return out + out.T


def forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first set of its component among the links between different sides (all, if there is one side)."""
    sizes = np.array([len(s) for s in sets])
    both = overlaps(sets)
    link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if side.min() != side.max():
        link &= side[:, None] != side[None, :]
    label = np.arange(len(sets))
    np.fill_diagonal(link, True)
    while True:
        new = np.where(link, label[None, :], len(sets)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verified(percent: int):
    """Over rows sorted by block pair: one block pair is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], np.int64)
            root = forest([np.frombuffer(r[1], np.uint64) for r in rows], np.array([r[2] for r in rows]), percent)
            own = np.flatnonzero(root != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

        held, key = [], None
        for batch in batches:
            for root, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "doc_id", "tokens", "block"))):
                if (root, i, j) != key:
                    if len(held) > 1:
                        yield links(held)
                    held, key = [], (root, i, j)
                held.append(tuple(row))
        if len(held) > 1:
            yield links(held)

    return run


def _candidates(groups: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """(a, b): pairs of groups to verify, or chains of such pairs, as group ids."""
    post = groups.select(F.explode("prefix").alias("token"), "gid", "n")
    known = post.groupBy("token").agg(F.count("*").alias("df"), F.min("gid").alias("least")).filter("df > 1")
    post = shelf.save(post.join(known, "token"), "postings")
    # A frequent shingle is cut by size: linked sets lie in the same size band or neighbouring ones,
    # so every set joins its own band's cell and the one below.
    band = F.floor(F.log("n") / (-math.log(percent / 100) * 1.001)).cast("int")
    often = post.filter(F.col("df") > PAIRS).select("token", "gid", "n", band.alias("band")).withColumn("cell", F.explode(F.array("band", F.col("band") - 1)))
    cells = often.groupBy("token", "cell").agg(F.count("*").alias("held"), F.min("gid").alias("first")).filter("held > 1")
    often = shelf.save(often.join(cells, ["token", "cell"]), "cells")
    few = post.filter(F.col("df") <= PAIRS).select("token", F.lit(None).cast("int").alias("cell"), "gid", "n", F.lit(None).cast("int").alias("band"))
    few = few.union(often.filter(F.col("held") <= CELL_PAIRS).select("token", "cell", "gid", "n", "band"))
    a, b = few.alias("a"), few.alias("b")
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    once = F.col("a.cell").isNull() | (F.col("a.cell") == F.least("a.band", "b.band"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & F.col("a.cell").eqNullSafe(F.col("b.cell"))) \
        .filter("a.gid < b.gid").filter(100 * low >= percent * high).filter(once)
    pairs = pairs.select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"), low.alias("low"), high.alias("high")) \
        .groupBy("a", "b", "low", "high").agg(F.count("*").alias("shared"))
    # Beyond its prefix a set of n has needed(n) - 1 shingles; the prefix that ends first bounds the overlap.
    rest = F.floor((F.col("high") * percent + 99) / 100) - 1
    overlap = F.floor(((F.col("low") + F.col("high")) * percent + (99 + percent)) / (100 + percent))
    # Pairs that also share a shingle of a crowded cell are tied by it, whatever they share here.
    pairs = pairs.filter(F.col("shared") + rest >= overlap).select("a", "b")
    many = often.filter(F.col("held") > CELL_PAIRS).filter("gid != first").select(F.col("gid").alias("a"), F.col("first").alias("b"))
    return pairs.union(many).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_shingles, class_id (smallest doc_id with an equal set) and component_id
    (smallest doc_id reachable by links of similarity ``percent`` / 100 or more)."""
    spark = docs.sparkSession
    small_batches(spark)
    shelf = Shelf(spark)
    sent = spark.sparkContext.broadcast(_hint(docs, size, shelf))
    rows = shelf.save(_bodies(docs).mapInArrow(
        _prefixes(size, percent, sent), "doc_id long, text_key long, n long, key_a long, key_b long, grp long, prefix array<long>"), "prefixes")
    real = rows.filter("n > 0 and doc_id is not null")
    groups = shelf.save(real.groupBy("grp", "n").agg(
        F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"),
        ((F.min("key_a") != F.max("key_a")) | (F.min("key_b") != F.max("key_b"))).alias("several")), "groups")
    classes = shelf.save(real.groupBy("key_a", "key_b", "grp", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    near = components(_candidates(groups.select("gid", "n", "prefix"), percent, shelf), shelf, "near")
    shelf.drop("postings")
    # Groups to expand: those with a candidate partner, and those that hold several sets.
    near = shelf.save(near, "near")
    wide = groups.select("gid", "grp", "n", "several").join(near.withColumnRenamed("node", "gid"), "gid", "left") \
        .filter("root is not null or several").select("grp", "n", F.coalesce("root", "gid").alias("root"))
    members = shelf.save(classes.join(wide, ["grp", "n"]), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).filter(F.count("*") > 1)
    chosen = shelf.save(members.join(sizes, "root").select(F.col("class_id").alias("doc_id"), "key_a", "key_b", "root", "blocks"), "chosen")
    sets = _bodies(docs).join(sendable(chosen), "doc_id").mapInArrow(_expanded(size), "doc_id long, root long, blocks int, tokens binary")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = sets.dropDuplicates(["doc_id", "root"]).withColumn("block", block) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "tokens")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = components(dealt.mapInArrow(_verified(percent), "a long, b long"), shelf, "links")
    links = shelf.save(links, "links")
    named = classes.join(links, F.col("class_id") == F.col("node"), "left") \
        .select("key_a", "key_b", "n", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    linked = real.select("doc_id", "text_key", "n", "key_a", "key_b").join(named, ["key_a", "key_b", "n"]) \
        .select("doc_id", "text_key", "n", "class_id", "component_id")
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "text_key", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for every component, the one with the smallest doc_id (of several, one text, once).
    Rows without words or doc_id stay."""
    shelf = Shelf(docs.sparkSession)
    found = shelf.save(near_duplicates(docs, size, percent).filter("n_shingles > 0 and doc_id is not null"), "components")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    gone = found.join(first, "component_id").filter(F.struct("doc_id", "text_key") != F.col("first"))
    gone = shelf.save(gone.select("doc_id", "text_key").distinct(), "gone")
    rows = packed(docs, "doc_id", F.xxhash64("text").alias("text_key")).alias("d")
    match = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    kept = rows.join(sendable(gone).alias("k"), match, "left_anti")
    again = shelf.save(found.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "again")
    if not again.take(1):
        return unpacked(kept, docs.columns)
    once = kept.alias("d").join(sendable(again).alias("k"), match, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return unpacked(kept.alias("d").join(sendable(again).alias("k"), match, "left_anti").unionByName(once), docs.columns)
