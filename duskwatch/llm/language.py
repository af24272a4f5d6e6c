"""Language of mixed texts: scripts narrow the candidates, then Viterbi labels the words.

A word is a run of letters. Its score for a language is the sum of the log chances of its letter
trigrams, with its edges. The script of a word leaves only languages that are written in it. Over
the words of a text a best path with a penalty for every switch gives one language per word, so
runs of words are spans; the language with most letters is the text's.

Most texts have one language. That its path is best is shown without the recursion: a path with
n switches has at most n + 1 runs in other languages, so if no other language gains more than half
the penalty over any run of words, no number of switches can pay. The other texts of a batch take the
recursion together, cut into segments that advance side by side.

Training counts, in tasks, the trigrams of a bounded sample of every language: about ``TEXTS``
texts, chosen by a hash of doc_id, and of a text of more than ``LONGEST`` characters a piece of
that length.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a word in a script
that no learned language has may be any; without a learned language every text is ``und``. A very
long text is labelled whole. Of languages with equal scores the first by name is taken. Repeated
rows get equal results and count as often as they come in training; an empty table gives no rows.
Only doc_id, text and, in training, lang are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .compression import held_out

TEXTS, LONGEST = 1500, 8_000
#: Cells of the trigram tables, and what an unseen trigram counts as.
CELLS, SMOOTH = 1 << 16, 0.3
SWITCH = 8.0
SLICES = 1 << 20
#: Words that the recursion takes as one segment, and up to how many languages texts are cut into segments.
SEGMENT, MANY = 128, 16
#: A language is written in a script that at least this share of its sample's words have.
SCRIPT_SHARE = 0.01

# First code points of script ranges and their scripts (Unicode blocks).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1C80, "cyrillic"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA720, "latin"), (0xA960, "hangul"), (0xA980, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"),
]
NAMES = sorted({s for _, s in SCRIPTS})


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case (its first character), its script's number."""
    every = [chr(c) for c in range(0x110000)]
    letter = np.array([c.isalpha() for c in every])
    lower = np.array([ord(c.lower()[0]) for c in every], np.uint32)
    starts = np.array([s for s, _ in SCRIPTS])
    script = np.array([NAMES.index(s) for _, s in SCRIPTS], np.int8)[np.searchsorted(starts, np.arange(len(every)), "right") - 1]
    return letter, lower, script


class Words:
    """The words of some texts: first code point and length, script, and trigram cells of their letters."""

    def __init__(self, texts: list[str]) -> None:
        letter, lower, script = _characters()
        data = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        is_letter = letter[data]
        self.start = np.flatnonzero(~is_letter[:-1] & is_letter[1:]) + 1
        self.end = np.flatnonzero(is_letter[:-1] & ~is_letter[1:]) + 1
        self.length = self.end - self.start
        self.text_at = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, self.text_at)
        own = np.where(is_letter, lower[data], 32).astype(np.uint64)
        mixed = own[1:-1] * np.uint64(0x9E3779B97F4A7C15) + own[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + own[2:] * np.uint64(0x165667B19E3779F9)
        cells = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
        self.cells = cells[is_letter[1:-1]].astype(np.int64)  # the letters' only, word after word
        self.offset = np.r_[0, np.cumsum(self.length)]
        self.script = script[data[self.start]]


def counted(texts: list[str]) -> np.ndarray:
    """How often each trigram cell, and behind them each script of a word, comes in the texts."""
    words = Words(texts)
    return np.r_[np.bincount(words.cells, minlength=CELLS), np.bincount(words.script, minlength=len(NAMES))]


class LanguageModel:
    """Languages, their scripts and trigram tables (256 KB each), as sent to the executors."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self._learn({lang: counted(texts) for lang, texts in samples.items()})

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        model = cls.__new__(cls)
        model._learn(counts)
        return model

    def _learn(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        self.table = np.zeros((len(self.languages), CELLS), np.float32)
        self.written = np.zeros((len(NAMES), len(self.languages)), bool)
        for k, lang in enumerate(self.languages):
            cells, scripts = counts[lang][:CELLS] + SMOOTH, counts[lang][CELLS:]
            self.table[k] = np.log(cells / cells.sum())
            self.written[:, k] = scripts / max(1, scripts.sum()) >= SCRIPT_SHARE
        self.written[~self.written.any(axis=1)] = True

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, languages): sums of log chances; far below all others where the script rules a language out."""
        out = np.empty((len(words.start), len(self.languages)), np.float64)
        step = max(1 << 10, (1 << 19) // max(8, len(self.languages)))
        for a in range(0, len(out), step):
            b = min(len(out), a + step)
            lo, hi = words.offset[a], words.offset[b]
            out[a:b] = np.add.reduceat(self.table[:, words.cells[lo:hi]], words.offset[a:b] - lo, axis=1, dtype=np.float64).T
        return np.where(self.written[words.script], out, out - 1e6)


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word of one text: the path of the highest score less ``switch`` for every change."""
    return best_paths(scores, np.array([0, len(scores)]), switch)


def best_paths(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best path of every text; text i has the words ``first[i]`` up to ``first[i + 1]``."""
    out, mixed = np.empty(len(scores), np.int64), []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if lo == hi:
            continue
        own = scores[lo:hi]
        main = int(own.sum(axis=0).argmax())
        gain = np.cumsum(np.vstack([np.zeros(own.shape[1]), own - own[:, main : main + 1]]), axis=0)
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch / 2:
            out[lo:hi] = main
        else:
            mixed.append((lo, hi))
    if mixed:
        _recursion(scores, mixed, switch, out)
    return out


def _recursion(scores: np.ndarray, texts: list[tuple[int, int]], switch: float, out: np.ndarray) -> None:
    """Viterbi for many texts at once, into ``out``.

    Texts are cut into segments of ``SEGMENT`` words, and all segments advance together, word by word, once for each
    language that the word before the segment may have. Chaining these tables gives every segment its first and last
    language, and all segments are traced back together.
    """
    k = scores.shape[1]
    size = SEGMENT if k <= MANY else len(scores)  # with many languages a text is one segment, and has no word before it
    cut = [(i, a, min(a + size, hi)) for i, (lo, hi) in enumerate(texts) for a in range(lo, hi, size)]
    cut.sort(key=lambda c: (c[1] - c[2], c[1]))  # longest first: those still running are always the first ones
    start, end = np.array([c[1] for c in cut]), np.array([c[2] for c in cut])
    length = end - start
    change = np.where(np.eye(k, dtype=bool), 0.0, -switch)[: k if k <= MANY else 1]
    opens = np.isin(start, [lo for lo, _ in texts])
    now = np.where(opens[:, None, None], 0.0, change) + scores[start][:, None]
    stay, came = np.arange(k), []
    running = np.searchsorted(-length, -np.arange(1, int(length[0])), "left")
    for t, m in enumerate(running.tolist(), 1):
        held = now[:m]
        top = held.argmax(axis=2)[..., None]
        moved = np.take_along_axis(held, top, 2) - switch
        move = moved > held
        came.append(np.where(move, top, stay).astype(np.int16))
        now[:m] = np.where(move, moved, held) + scores[start[:m] + t][:, None]
    # Chain the segments of each text, then choose from its end.
    entered, last = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
    chains: dict[int, list[int]] = {}
    for row in sorted(range(len(cut)), key=lambda r: start[r]):
        chains.setdefault(cut[row][0], []).append(row)
    for rows in chains.values():
        total, sources = now[rows[0], 0], []
        for row in rows[1:]:
            through = total[:, None] + now[row]
            sources.append(through.argmax(axis=0))
            total = through.max(axis=0)
        state = int(total.argmax())
        for row, source in zip(rows[:0:-1], reversed(sources)):
            last[row], entered[row] = state, source[state]
            state = int(source[state])
        last[rows[0]] = state
    state = last.copy()
    out[end - 1] = state
    for t in range(len(running), 0, -1):
        m = running[t - 1]
        state[:m] = came[t - 1][np.arange(m), entered[:m], state[:m]]
        out[start[:m] + t - 1] = state[:m]


def label(model: LanguageModel, texts: list[str], switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
    """Of each text its language, the share of its letters in it, and its spans in code points."""
    words = Words(texts)
    paths = best_paths(model.word_scores(words), words.first, switch)
    out = []
    for i in range(len(texts)):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        if lo == hi:
            out.append(("und", 0.0, []))
            continue
        path = paths[lo:hi]
        letters = np.bincount(path, weights=words.length[lo:hi], minlength=len(model.languages))
        best = int(letters.argmax())
        cut = np.r_[0, np.flatnonzero(np.diff(path)) + 1, hi - lo]
        at = words.text_at[i]
        spans = [{"start": int(words.start[lo + a] - at), "end": int(words.end[lo + b - 1] - at), "lang": model.languages[path[a]]}
                 for a, b in zip(cut[:-1], cut[1:])]
        out.append((model.languages[best], float(letters[best] / letters.sum()), spans))
    return out


def fit(docs: DataFrame, texts: int = TEXTS) -> LanguageModel:
    """Learns from the text and lang of rows that are not held out."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # One row for each language reaches the driver, and the cells that its sample has; shares go back as a small table.
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    shares = docs.sparkSession.createDataFrame([(lang, min(SLICES, 1 + texts * SLICES // n)) for lang, n in counts.items()], "lang string, share long")
    chosen = own.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) < F.col("share"))
    start = 1 + F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.greatest(F.lit(1), F.length("text") - LONGEST + 1))
    small_batches(docs.sparkSession)
    cells = chosen.select("lang", F.substring("text", start.cast("int"), F.lit(LONGEST)).alias("text")).mapInArrow(_count, "lang string, cell int, n long")
    found = cells.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    learned = {lang: np.zeros(CELLS + len(NAMES), np.int64) for lang in counts}
    groups = found.column("lang").combine_chunks().dictionary_encode()
    groups = groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups
    of, cell, n = groups.indices.to_numpy(), found.column("cell").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(groups.dictionary) + 1))
    for k, lang in enumerate(groups.dictionary.to_pylist()):
        rows = order[ends[k] : ends[k + 1]]
        learned[lang][cell[rows]] = n[rows]
    return LanguageModel.of_counts(learned)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): the counts of each batch's texts."""
    for batch in batches:
        samples: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            samples.setdefault(lang, []).append(text)
        for lang, own in samples.items():
            counts = counted(own)
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(counts[cells], pa.int64())], names=["lang", "cell", "n"])


def _predict(sent, switch: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [(t or "").encode() for t in texts]
            found = []
            # Scores are a number for each word and language: fewer words at a time where there are many.
            for lo, hi in chunks(sizes, max(1 << 13, min(1 << 19, (1 << 24) // max(1, len(model.languages))))):
                own = [t or "" for t in texts[lo:hi]]
                found += label(model, own, switch) if model.languages else [("und", 0.0, [])] * len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def predict(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(
        _predict(sent, switch), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
