import random

import brute
import pytest
from text_helpers import CLASHES, prose

from duskwatch.llm import components, decontaminate, jaccard, lines
from duskwatch.session import Shelf


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_contamination_against_brute_force(spark, edge, edge_rows):
    rng = random.Random(1)
    texts = [prose(rng, 60, 4) for _ in range(30)]
    items = [(i, t[: rng.randrange(20, 60)]) for i, t in enumerate(texts[:8])]
    items += [(20, "a1"), (21, "A1 b2"), (22, "c3, d4; e1"), (23, None), (24, "!!"), (None, "a2 b3"), (20, "a1"), (25, texts[9].upper()), (26, "word")]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + k, f"x {items[k][1]} y {items[k][1]}") for k in range(8)] + [(7, texts[7]), (7, "other A1 B2")]
    got = decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(brute.contamination(docs, items))
    got = decontaminate.contamination(edge, frame(spark, items, "item_id long, text string"))
    assert got.count() == len(edge_rows)
    kept = decontaminate.clean(edge, frame(spark, items, "item_id long, text string"))
    assert kept.columns == edge.columns and {r._row for r in kept.select("_row").collect()} == {"mine"}
    assert kept.count() == len(edge_rows) - 2  # the two of one word that is an item


def test_contamination_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, prose(rng, 50, 3)) for i in range(12)]
    items = [(i, t[5:70]) for i, t in docs]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    got = decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(brute.contamination(docs, items))


def test_contamination_of_nothing(spark, nothing, edge, edge_rows):
    empty = frame(spark, [], "item_id long, text string")
    assert decontaminate.contamination(nothing, empty).count() == 0
    assert decontaminate.clean(edge, empty).count() == len(edge_rows)


def corpus(rng):
    docs = []
    for k in range(40):
        base = prose(rng, rng.choice([3, 8, 30, 60]), 9)
        for _ in range(rng.choice([1, 1, 3, 9])):
            w = base.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
            docs.append(" ".join(w[: len(w) - rng.choice([0, 0, 1, 3])]))
    return [(i, t) for i, t in enumerate(docs)] + [(500, None), (501, ""), (0, docs[3]), (5, docs[5]), (None, docs[1])]


@pytest.mark.parametrize("limits", [None, (2, 3, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, limits):
    """Also with limits so low that cells, ties and several blocks are all in use."""
    if limits:
        for name, value in zip(("PAIRS", "CELL_PAIRS", "BLOCK"), limits):
            monkeypatch.setattr(jaccard, name, value)
    for seed, size, percent in ((1, 4, 85), (2, 3, 60)):
        docs = corpus(random.Random(seed))
        got = jaccard.near_duplicates(frame(spark, docs), size, percent).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute.near(docs, size, percent), key=key)


def test_one_of_each(spark, edge, edge_rows, nothing):
    got = jaccard.one_of_each(edge)
    assert got.columns == edge.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(brute.one_of_each(edge_rows, 5, 80), key=key)
    assert all(r[c] == "mine" for r in got.collect() for c in CLASHES)
    assert jaccard.one_of_each(nothing).count() == 0


def test_components(spark):
    rng = random.Random(5)
    chain = [(i + 1, i) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7000, k) for k in range(7001, 7050)]
    label = {}
    for a, b in chain:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in chain:
            label[a] = label[b] = min(label[a], label[b])
    got = components.components(frame(spark, chain, "a long, b long"), Shelf(spark), "c").collect()
    alone = {n for n in label if all(a == b for a, b in chain if n in (a, b))}
    assert {r.node: r.root for r in got} == {k: v for k, v in label.items() if k not in alone}
    assert components.components(frame(spark, [], "a long, b long"), Shelf(spark), "c").count() == 0


def test_line_dedup_against_brute_force(spark, edge, edge_rows, nothing):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(6)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a\na\na\na\na\na"), (103, "a\r\n\na\na")]
    got = lines.dedup_lines(frame(spark, docs)).collect()
    want = brute.dedup_lines(docs)
    assert sorted((r.doc_id, r.text or "", r.n_lines, r.n_removed) for r in got) == sorted((d, t or "", n, m) for d, t, n, m in want)
    out = lines.without_repeats(edge)
    assert out.columns == edge.columns and nothing.count() == lines.without_repeats(nothing).count() == 0
    left = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    # The row without id comes first; the same three lines elsewhere are cut, and documents of nothing else go.
    assert 6 not in left and 7 not in left and left[13] == edge_rows[-1][1].split("\n")[-1] and left[2] == "" and left[1] is None
