"""Packing of documents into sequences of a fixed capacity, by harmonic classes.

A document is its token ids and an end id. Pieces whose length lies in (C / (k + 1), C / k] of the
capacity C form class k, and a bin of class k holds k of them, whatever else is open. Documents may
be cut, so each is cut at the binary digits of its length: pieces of C, then at most one each of
C / 2, C / 4, ... 1. Their lengths are the upper ends of classes 1, 2, 4, ... C, so that a bin of k
pieces is full to the last token. A worker fills its bins alone, in one pass over its rows, with
fewer than C open tokens in each class and no shuffle. At the end of its rows the pieces left in a
class (fewer than k) become sequences of a power of two of them, so their lengths are powers of two
as well, which sequences need not be padded beyond.

Ids are those of the tokenizer's rank file without special tokens: their strings are ordinary text.

Defined cases: a null text is empty and an empty one is its end id alone; a very long text is cut
like any other and handed on piece by piece; rows with the same or no doc_id are documents of their
own; an empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
Sequence numbers hold the worker's partition and its count, so a repeated task gives the same ones.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CAPACITY, END = 2048, 1
#: Tokens handed on at once.
SEND_TOKENS = 1 << 19
#: Sequences a worker may number.
NUMBERS = 1 << 40


@functools.lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as file:
        own = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, size) of a document's pieces: whole sequences, then the binary digits of the rest."""
    start = 0
    while start < length:
        size = min(capacity, 1 << ((length - start).bit_length() - 1))
        yield start, size
        start += size


class Bins:
    """The open bins of one worker. Takes pieces and gives those whose sequence is complete, with its number and their offset."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.number = capacity, first
        self.open: dict[int, list] = {}

    def put(self, size: int, piece: tuple) -> Iterator[tuple]:
        """``piece`` goes to class k = capacity / size; a bin is complete at k pieces."""
        waiting = self.open.setdefault(size, [])
        waiting.append(piece)
        if len(waiting) == self.capacity // size:
            self.open[size] = []
            yield from self._numbered(size, waiting)

    def close(self) -> Iterator[tuple]:
        """The rest of each class, in sequences of a power of two of pieces."""
        for size, waiting in sorted(self.open.items()):
            for start, count in cuts(len(waiting), self.capacity):
                yield from self._numbered(size, waiting[start : start + count])
        self.open = {}

    def _numbered(self, size: int, pieces: list) -> Iterator[tuple]:
        for k, piece in enumerate(pieces):
            yield (*piece, self.number, k * size)
        self.number += 1


def _pack(ranks: str, pattern: str, capacity: int, end: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).encode_to_numpy
        bins = Bins(capacity, TaskContext.get().partitionId() * NUMBERS)
        ready: list[tuple] = []
        tokens = 0

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
            ready.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for start, size in cuts(len(ids), capacity):
                    ready.extend(bins.put(size, (doc_id, start, size, ids[start : start + size].tobytes(), len(ids))))
                    tokens += size
                    if tokens >= SEND_TOKENS and ready:
                        yield sent()
                        tokens = 0
        ready.extend(bins.close())
        if ready:
            yield sent()

    return run


def pack(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece; ``ids`` are 32-bit little-endian."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(
        _pack(ranks, pattern, capacity, end, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the pieces of each sequence, at most its capacity, put together in order."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(own.alias("own")).select(
        "sequence_id", F.aggregate("own.length", F.lit(0).cast("long"), lambda a, b: a + b).alias("length"),
        F.aggregate("own.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("own.doc_id").alias("doc_ids"))
