"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The text is normalised as the models of this kind do: a space before it, every space written as
``▁``. The automaton reads it once; at every position its outputs (the pieces that end there,
longest first, found along the output links) relax the best score of that position. The path of
the highest score sum wins, the longer last piece between equals. A character without a piece
costs the lowest score less 10 and becomes its UTF-8 bytes' pieces, so every text comes back
exactly, a literal ``▁`` too.

If no piece goes on from another character to ``▁`` (the models split at spaces), best paths of
the parts between such places are independent: each part is a pass of its own, and short parts
are remembered.

Defined cases: null gives null, the empty text no pieces; rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

SPACE = "▁"
#: Stands for a literal ``▁`` while matching; no piece has it.
LITERAL = "￿"
PENALTY = 10.0
#: Parts remembered by a worker, and the longest such part.
REMEMBERED, LONGEST = 1 << 19, 40


class PieceTable:
    """Pieces, scores and bytes of a model, as sent to the executors; its size is the model file's."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.key = model_path
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces: list[tuple[str, int, float]] = []
        self.raw = [b""] * model.get_piece_size()
        self.byte = [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces.append((piece, i, model.get_score(i)))
                self.raw[i] = piece.replace(SPACE, " ").encode()
        if -1 in self.byte:
            raise ValueError("the model has no byte pieces, so some texts could not come back")
        self.unknown = min(s for _, _, s in self.pieces) - PENALTY
        self.splits = not any(SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces)


class Encoder(dict):
    """Part of a text (normalised) -> its piece ids as bytes of int32; remembers short parts."""

    def __init__(self, table: PieceTable) -> None:
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in table.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if table.splits else "(?s:.+)").findall

    def best_path(self, part: str) -> list[int]:
        n, unknown = len(part), self.table.unknown
        best = [0.0] + [-np.inf] * n
        back, by = [0] * (n + 1), [-1] * (n + 1)
        done = 0
        for end, (length, score, i) in self.automaton.iter(part):
            end += 1
            while done < end - 1:  # positions where no piece ends are reached by an unknown character
                done += 1
                if best[done - 1] + unknown > best[done]:
                    best[done], back[done], by[done] = best[done - 1] + unknown, done - 1, -1
            score += best[end - length]
            if score > best[end]:
                best[end], back[end], by[end] = score, end - length, i
        while done < n:
            done += 1
            if best[done - 1] + unknown > best[done]:
                best[done], back[done], by[done] = best[done - 1] + unknown, done - 1, -1
        out, at = [], n
        while at:
            if by[at] >= 0:
                out.append(by[at])
            else:
                char = part[at - 1]
                out += [self.table.byte[b] for b in reversed((SPACE if char == LITERAL else char).encode())]
            at = back[at]
        return out[::-1]

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.best_path(part), np.int32).tobytes()
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if LITERAL in text:  # rare: keep it apart from the stand-in
            return np.array(self._mixed(text), np.int32)
        normal = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.__getitem__, self.parts(normal))), np.int32)

    def _mixed(self, text: str) -> list[int]:
        """A text that has the stand-in itself: it has no piece, so the text is cut there."""
        out, first = [], SPACE
        for k, piece in enumerate(text.split(LITERAL)):
            if k:
                out += [self.table.byte[b] for b in LITERAL.encode()]
            normal = first + piece.replace(SPACE, LITERAL).replace(" ", SPACE)
            first = ""
            for part in self.parts(normal):
                out += np.frombuffer(self[part], np.int32).tolist()
        return out


#: Encoders of this worker by model: tasks that follow each other share what is remembered.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(table: PieceTable) -> Encoder:
    if table.key not in _ENCODERS:
        _ENCODERS[table.key] = Encoder(table)
    return _ENCODERS[table.key]


def decode_ids(ids: np.ndarray, raw: list[bytes]) -> str:
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def _encode(sent, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            found = [None if t is None else encoder.encode(t) for t in batch.column(name).to_pylist()]
            offsets = np.cumsum([0] + [0 if f is None else len(f) for f in found])
            flat = np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int32)])
            mask = pa.array([f is None for f in found])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=mask)
            rest = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), ids], names=[*rest, "ids"])

    return run


def _decode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = sent.value.raw
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy())]
            null = ids.is_null().to_pylist()
            text = [None if null[k] else decode_ids(flat[at[k] : at[k + 1]].tolist(), raw) for k in range(len(ids))]
            rest = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(text, pa.string())], names=[*rest, "decoded"])

    return run


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (the piece numbers) in place of the column ``text``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(PieceTable(model_path))
    schema = T.StructType([f for f in docs.schema if f.name not in (text, "ids")] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*(c for c in docs.columns if c == text or c != "ids")).mapInArrow(_encode(sent, text), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``, the text of ``ids``."""
    small_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(PieceTable(model_path))
    own = encoded.select(*(c for c in encoded.columns if c != "decoded"))
    return own.mapInArrow(_decode(sent), T.StructType([*own.schema, T.StructField("decoded", T.StringType())]))
