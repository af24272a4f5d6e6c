"""Quality by compression: zstandard dictionaries of good and bad text, and the sizes they give.

A text is compressed with a dictionary trained on good texts and one trained on bad texts. The
difference of the sizes over their sum says which it resembles; a logistic curve, fitted on other
labelled texts, turns it into a chance of being good.

Training reads a bounded sample: of each label about ``DICTIONARY_TEXTS`` texts for the
dictionaries and about as many others for the curve, chosen by a hash of doc_id among labelled
texts of at most ``LONGEST_SAMPLE`` bytes. Scoring compresses every text whole.

Defined cases: null texts are scored as empty ones; labels other than 0 and 1,
null doc_ids and documents labelled both ways are not learned from; if a label has next to no
sample, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DICTIONARY_TEXTS = 3000
LONGEST_SAMPLE = 16_384
DICTIONARY_BYTES = 110 << 10
#: Fewer texts of a label train no dictionary.
LEAST_TEXTS = 8
LEVEL = 3
SLICES = 1 << 20


def held_out(doc_id: Column) -> Column:
    """The rows no model learns from: a fixed quarter by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Compressor:
    """Dictionaries and curve, as sent to the executors (some 230 KB)."""

    def __init__(self, good: list[bytes], bad: list[bytes], curve: list[tuple[bytes, int, float]]) -> None:
        """``curve``: texts, their labels and their weights."""
        import zstandard

        self.dictionaries: list[bytes] = []
        if len(good) >= LEAST_TEXTS and len(bad) >= LEAST_TEXTS and len({y for _, y, _ in curve}) == 2:
            self.dictionaries = [zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, t)) // 8)), t, level=LEVEL).as_bytes()
                                 for t in (good, bad)]
            x = np.array([self.features(t) for t, _, _ in curve])
            self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
            self.weights = fit_curve((x - self.mean) / self.spread, np.array([y for _, y, _ in curve], float), np.array([w for *_, w in curve]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_own"}

    def sizes(self, text: bytes) -> list[int]:
        if "_own" not in self.__dict__:
            import zstandard

            self._own = []
            for data in self.dictionaries:
                held = zstandard.ZstdCompressionDict(data)
                held.precompute_compress(level=LEVEL)
                self._own.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return [len(c.compress(text)) for c in self._own]

    def features(self, text: bytes) -> list[float]:
        """The normalised size difference, and what tells how much it weighs: length and both rates."""
        good, bad = self.sizes(text)
        length = len(text) + 20
        diff, rate, other, log = (bad - good) / (bad + good), good / length, bad / length, np.log(length)
        return [diff, diff * log, rate, rate * log, log, rate * rate, diff * diff, other, other * other]

    def score(self, text: bytes) -> float:
        if not self.dictionaries:
            return 0.5
        z = self.weights[0] + (np.array(self.features(text)) - self.mean) / self.spread @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic curve over standardised features, by Newton's method with step halving."""
    a, weight = np.c_[np.ones(len(x)), x], weight / weight.sum()
    pull = ridge * np.r_[0, np.ones(x.shape[1])]

    def cost(w: np.ndarray) -> float:
        z = a @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + pull @ (w * w) / 2)

    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (weight * (p - y)) + pull * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), slope)
        now, scale = cost(w), 1.0
        while cost(w - scale * step) > now and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", texts: int = DICTIONARY_TEXTS) -> list[tuple[int, bytes, int, float]]:
    """About twice ``texts`` labelled texts of each label, in a fixed order: (doc_id, text, label, weight); the
    weight makes up for the label's share of the sample."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("_y")).filter("y = _y").drop("_y")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return []
    cut = F.when(F.col("y") == 1, F.lit(min(SLICES, 2 * texts * SLICES // counts[1]))).otherwise(F.lit(min(SLICES, 2 * texts * SLICES // counts[0])))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) < cut)  # some thousand ids
    own = docs.filter(F.octet_length("text").between(1, LONGEST_SAMPLE)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "body", "y").collect()
    held = [sum(r["y"] == y for r in rows) for y in (0, 1)]
    return sorted((r["doc_id"], bytes(r["body"]), int(r["y"]), counts[r["y"]] / held[r["y"]]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", texts: int = DICTIONARY_TEXTS) -> Compressor:
    rows = sample(docs, labels, label, texts)
    # Every other text of the sorted sample trains the dictionaries, the rest the curve.
    good = [t for _, t, y, _ in rows[::2] if y == 1]
    bad = [t for _, t, y, _ in rows[::2] if y == 0]
    return Compressor(good, bad, [r[1:] for r in rows[1::2]])


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Compressor = sent.value
        for batch in batches:
            out = [model.score(t or b"") for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Compressor) -> DataFrame:
    """(doc_id, score): the chance that each text is good."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(_score(sent), "doc_id long, score double")
