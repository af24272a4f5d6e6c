"""Packing and the fill-in-the-middle transformation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from text_helpers import CLASHES

from duskwatch.llm import infill, packing

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_vocabulary_file():
    rng = random.Random(4)
    kinds = [chr(c) for c in (*range(0x20, 0x250), 0x2028, 0x3000, 0x4E00, 0x0660, 0xAC00, 0x1F600, 0x1D7D8, 0x0301, 0x00A0, 9, 10, 13, 0)]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["I'll we've  don't 'S\n\n x", "<|endoftext|>", "x" * 5000, " " * 3000, "", "日本語 한국어 العربية 123٣"]
    encode = packing.encoder(RANKS, PATTERN).encode_to_numpy
    assert [encode(t).tolist() for t in texts] == library_ids(texts)


def test_cuts_and_bins():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 1 << 20):
        pieces = list(packing.cuts(n, 2048))
        assert sum(s for _, s in pieces) == n and all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:]))
        assert all(s & (s - 1) == 0 for _, s in pieces) and len(pieces) <= n // 2048 + 11
    bins = packing.Bins(8, 100)
    out = [p for k in range(11) for p in bins.put(2, (k,))]
    assert [(p, s, o) for p, s, o in out] == [(k, 100 + k // 4, k % 4 * 2) for k in range(8)]
    assert [(p, s, o) for p, s, o in bins.close()] == [(8, 102, 0), (9, 102, 2), (10, 103, 0)] and not list(bins.close())


def test_packing_round_trip(spark, edge, edge_rows, nothing):
    rng = random.Random(6)
    docs = edge.select("doc_id", "text", *CLASHES).unionByName(
        spark.createDataFrame([(100 + i, "word tail " * rng.randrange(900)) for i in range(60)], "doc_id long, text string")
        .withColumns({c: F.lit("mine") for c in CLASHES}))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    packed = packing.pack(docs.repartition(3), RANKS, PATTERN).collect()
    want = sorted((str(i), ids + [1]) for (i, _), ids in zip(rows, library_ids([t for _, t in rows])))
    held = defaultdict(list)
    for p in packed:
        assert len(p.ids) == 4 * p.length and p.length > 0
        held[p.sequence_id].append((p.offset, p.length))
    for own in held.values():  # gapless, and nothing to pad
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert len(held) <= sum(len(ids) for _, ids in want) // 2048 + 3 * 66
    # Documents with one id are told apart by their order of pieces alone, so compare the multiset of tokens then.
    single = {i for i, _ in want if sum(j == i for j, _ in want) == 1}
    whole = defaultdict(list)
    for p in packed:
        whole[str(p.doc_id)].append(p)
    for i, ids in want:
        own = sorted(whole[i], key=lambda p: p.start)
        if i in single:
            assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids and {p.doc_tokens for p in own} == {len(ids)}
            assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
    assert sum(p.length for p in packed) == sum(len(ids) for _, ids in want)
    frame = packing.pack(docs.repartition(3), RANKS, PATTERN)
    lengths = {r.sequence_id: r for r in packing.sequences(frame).collect()}
    assert all(len(r.ids) == 4 * r.length and len(r.doc_ids) >= 1 for r in lengths.values())
    assert sum(r.length for r in lengths.values()) == sum(p.length for p in packed)
    crcs = frame.filter("doc_id = 8").select("ids", F.crc32("ids").alias("c")).collect()
    assert [r.c for r in crcs] == [zlib.crc32(bytes(r.ids)) for r in crcs]
    assert packing.pack(nothing, RANKS, PATTERN).count() == 0


def plain_transform(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_infill_against_loop(spark, edge, nothing):
    rng = random.Random(8)
    parts = ["a", "Zz", " ", "\n", "<", "<S", ">", "S>", "é", "😀", "<P>", "x1", "\r\n", " ", "<M"]
    rows = [(i, "".join(rng.choices(parts, [9, 9, 9, 3, 9, 9, 9, 9, 3, 3, 0.3, 3, 3, 3, 9], k=rng.randrange(40)))) for i in range(800)]
    own = edge.unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit("mine") for c in CLASHES}}))
    out = infill.fill_in_middle(own)
    assert set(out.columns) == {*own.columns, "n", "form", "prefix_chars", "middle_chars", "output"}
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == own.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_transform(r.doc_id, r.text or "")
        assert r.back == (r.text or "") and r.host == "mine"
    assert {r.form for r in got} == {"plain", "psm", "spm"} and infill.fill_in_middle(nothing).count() == 0
