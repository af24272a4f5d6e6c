import random

import brute
import corpus_pipeline
from text_helpers import CLASHES, prose

from duskwatch.llm import pieces, quality
from duskwatch.llm.oracle import ORACLE
from duskwatch.llm.queries import PIECE_MODEL, REGISTRY


def corpus():
    rng = random.Random(11)
    docs, items = [], [(i, prose(rng, 14)) for i in range(6)]
    lines = ["\n".join(prose(rng, 9) + "." for _ in range(3)) for _ in range(3)]
    for k in range(50):
        text = "\n".join(prose(rng, rng.randrange(4, 25)) + rng.choice([".", ".", ".", "!", " |"]) for _ in range(rng.randrange(1, 7)))
        kind = k % 7
        text = {0: text, 1: text + "\n" + rng.choice(lines) + "\nand the end of it.", 2: text + " " + rng.choice(items)[1] + ".",
                3: "a | b | c\nx | y | z", 4: "word word " * 20}.get(kind, text)
        docs.append(text)
        if kind >= 5:
            docs.append(text.replace(text.split()[3], "changed", 1))
        if kind == 6:
            docs.append(text)
    return [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (902, prose(rng, 12) + ".\n\n")], items


def expected(docs, items):
    judged = [(d, brute.quality(t, quality)) for d, t in docs]
    docs = [(d, q["cleaned"]) for d, q in judged if q["kept"]]
    docs = [(d, t) for d, t, _, gone in brute.dedup_lines(docs) if not gone or brute.SPACE.search(t)]
    docs = brute.one_of_each(docs, 5, 80)
    docs = [(d, t) for (d, t), (_, _, hit, _) in zip(docs, brute.contamination(docs, items)) if not hit]
    table = pieces.PieceTable(PIECE_MODEL)
    return {d: brute.best_pieces(t, table) for d, t in docs}


def test_run_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(docs, items)
    assert {r.doc_id: r["ids"] for r in got} == want and all(r.exact and r.n_pieces == len(r["ids"]) for r in got)
    assert 10 < len(want) < len(docs) - 15


def test_stages_keep_columns_and_take_edges(spark, edge, nothing, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r[c] == "mine" for r in rows for c in CLASHES), name
            if name != "line dedup":
                assert not {r.text for r in rows} - {r.text for r in docs.select("text").collect()} or name == "quality rules"
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()


def test_registry():
    assert {k.split("_")[0] for k in REGISTRY} == {f"op{i}" for i in range(1, 11)} and set(ORACLE) <= set(REGISTRY)
