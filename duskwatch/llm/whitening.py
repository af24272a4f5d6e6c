"""Whitening of embeddings from exact integer cross-products.

An entry c counts as the integer x = floor(64 c) + 1000000. The fit list holds every distinct
vector of such integers once. Each task shifts its rows' dimensions to start at 0 and packs, for
every dimension, each bit of the shifted values across rows into 64-bit words (bit-sliced
scatter). The sum over rows of x_d * x_e is then the sum over pairs of bit planes of
2^(i + j) * popcount(plane_i(d) AND plane_j(e)), exactly. Tasks hand over one number for each pair
of dimensions, whatever their rows; Spark adds them up. The covariance is centred in integers,
n * sum(x_d x_e) - sum(x_d) sum(x_e), and becomes double only then, before ``eigh``.

The only shuffle is that of the distinct vectors; what reaches the driver grows with the square of
the dimensions, never with rows. The whitened values of the fit list are measured in a further pass:
``identity_error`` is the largest entry of their covariance less the identity.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries go. Entries beyond
+-2^55 count as that bound. Vectors of different lengths are spaces of their own, each fitted alone;
an empty vector has no components. A component without variance (below 1e-13 of the trace, as with
one distinct vector) has whitened 0 and is left out of ``identity_error``. Repeated rows count once
in the fit and each get their result; ids may be null or repeated. An empty table gives no rows.
Only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf

SCALE, OFFSET, BOUND = 64, 1_000_000, float(1 << 55)
COMPONENTS = 16
#: Rows packed at once, and words compared at once (8 MB).
BLOCK_ROWS, BLOCK_WORDS = 4096, 1 << 20
#: Sums travel as digits of so many bits, so that sums of them over all tasks fit a long.
DIGIT = 30
FLAT = 1e-13

Matrix = np.ndarray


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the rows that stay, with their integers."""
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.least(F.greatest(v, F.lit(-BOUND)), F.lit(BOUND)) * SCALE).cast("long") + OFFSET)
    return vectors.filter(c.isNotNull() & finite).select(F.col(f"`{id_column}`").alias("id"), x.alias("x"))


def _spaces(x: pa.ListArray) -> Iterator[tuple[Matrix, Matrix]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = np.diff(x.offsets.to_numpy())
    flat, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()[:-1]
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, flat[at[rows, None] + np.arange(size)].reshape(len(rows), size)


def _bits(values: Matrix) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))).bit_length()


def cross_products(u: Matrix) -> Matrix:
    """The exact sums over rows of u_d * u_e as Python ints, by weighted popcounts of bit planes."""
    rows, size = u.shape
    low = u.min(axis=0)
    shifted = u.astype(np.uint64) - low.astype(np.uint64)  # the true difference, even where a long would overflow
    planes = int(shifted.max()).bit_length()
    words = -(-rows // 64)
    packed = np.zeros((planes, size, words * 8), np.uint8)
    for p in range(planes):
        bits = np.packbits(((shifted >> np.uint64(p)) & np.uint64(1)).astype(bool).T, axis=1)
        packed[p, :, : bits.shape[1]] = bits
    sliced = packed.view(np.uint64)
    by_weight = np.zeros((max(1, 2 * planes - 1), size, size), np.int64)
    step = max(1, BLOCK_WORDS // (size * words))
    for p in range(planes):
        for q in range(p + 1):
            for d in range(0, size, step):
                both = np.bitwise_count(sliced[p, d : d + step, None] & sliced[q, None]).sum(axis=-1, dtype=np.int64)
                by_weight[p + q, d : d + step] += both
                if p != q:
                    by_weight[p + q, :, d : d + step] += both.T
    exact = np.int64 if 2 * planes + (rows * planes).bit_length() < 62 else object
    out = sum((by_weight[s].astype(exact) * (1 << s) for s in range(1, len(by_weight))), by_weight[0].astype(exact)).astype(object)
    # From shifted values back to u: sum (y_d + l_d)(y_e + l_e).
    sums = np.array([int(v) for v in shifted.astype(object).sum(axis=0)], object) if planes > 40 else shifted.sum(axis=0).astype(object)
    base = low.astype(object)
    return out + np.outer(sums, base) + np.outer(base, sums) + rows * np.outer(base, base)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while value:
        yield k, sign * (value & ((1 << DIGIT) - 1))
        value, k = value >> DIGIT, k + 1


class _Sums:
    """Count, sums and cross-products of one task's vectors of one length."""

    def __init__(self, size: int) -> None:
        self.waiting, self.rows, self.count = [], 0, 0
        self.sums, self.cross = np.zeros(size, object), np.zeros((size, size), object)

    def add(self, u: Matrix) -> None:
        self.waiting.append(u)
        self.rows += len(u)
        if self.rows >= BLOCK_ROWS:
            self.pack()

    def pack(self) -> None:
        if self.rows:
            u = np.concatenate(self.waiting)
            for a in range(0, len(u), BLOCK_ROWS):
                part = u[a : a + BLOCK_ROWS]
                self.cross += cross_products(part)
                self.sums += part.astype(object).sum(axis=0) if _bits(part) > 48 else part.sum(axis=0).astype(object)
            self.count += len(u)
            self.waiting, self.rows = [], 0

    def cells(self, size: int) -> Iterator[tuple[int, int, int, int, int]]:
        self.pack()
        yield size, -1, -1, 0, self.count
        for d in range(size):
            yield from ((size, d, -1, k, v) for k, v in _digits(int(self.sums[d])))
            for e in range(d + 1):
                yield from ((size, d, e, k, v) for k, v in _digits(int(self.cross[d, e])))


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spaces: dict[int, _Sums] = {}
    for batch in batches:
        for _, x in _spaces(batch.column("x")):
            if x.shape[1]:
                spaces.setdefault(x.shape[1], _Sums(x.shape[1])).add(x - OFFSET)
    for size, sums in spaces.items():
        cells = list(sums.cells(size))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["size", "d", "e", "k", "v"])


class Space:
    """The fit for one vector length: count, exact sums of x - OFFSET, and the leading components."""

    def __init__(self, size: int, cells: dict[tuple[int, int], int], components: int) -> None:
        n = self.n = cells[-1, -1]
        self.sums = [cells.get((d, -1), 0) for d in range(size)]
        # Centred in integers; an int over an int is the nearest double.
        cov = np.array([[(n * cells.get((max(d, e), min(d, e)), 0) - self.sums[d] * self.sums[e]) / (n * n) for e in range(size)] for d in range(size)])
        values, vectors = np.linalg.eigh(cov)
        own = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(cov))
        self.values, self.axes = values[own], vectors[:, own]
        self.varies = self.values > FLAT * self.trace
        self.explained = [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]
        self.identity_error = 0.0

    def centred(self, x: Matrix) -> Matrix:
        """n * x - S, exactly."""
        u = x - OFFSET
        wide = _bits(u) + self.n.bit_length() > 61
        return u.astype(object if wide else np.int64) * self.n - np.array(self.sums, object if wide else np.int64)

    def deviations(self, centred: Matrix) -> list[int]:
        if centred.dtype != object and 2 * _bits(centred) + centred.shape[1].bit_length() > 62:
            centred = centred.astype(object)
        return [int(v) for v in (centred * centred).sum(axis=1)]

    def whitened(self, centred: Matrix) -> Matrix:
        scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        return (centred / self.n).astype(np.float64) @ self.axes * scale


class WhiteningModel:
    """One ``Space`` for each vector length; its size goes with the dimensions alone."""

    def __init__(self, spaces: dict[int, Space]) -> None:
        self.spaces = spaces


def _moments(sent):
    """Sums of whitened values and of their products. They are centred already, so nothing is lost to their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[Matrix, Matrix]] = {}
        for batch in batches:
            for _, x in _spaces(batch.column("x")):
                if x.shape[1]:
                    space = sent.value.spaces[x.shape[1]]
                    w = space.whitened(space.centred(x))
                    s, p = total.get(x.shape[1], (0, 0))
                    total[x.shape[1]] = s + w.sum(axis=0), p + w.T @ w
        for size, (s, p) in total.items():
            rows = [(size, i, -1, float(v)) for i, v in enumerate(s)] + [(size, i, j, float(p[i, j])) for i in range(len(s)) for j in range(i + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
                                             names=["size", "i", "j", "v"])

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> WhiteningModel:
    """The model of ``quantized`` rows."""
    spark = rows.sparkSession
    shelf = Shelf(spark)
    distinct = shelf.save(rows.select("x").distinct(), "fit-list")
    cells = distinct.mapInArrow(_scatter, "size int, d int, e int, k int, v long").groupBy("size", "d", "e", "k").agg(F.sum("v").alias("v"))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for size, d, e, k, v in cells.collect():
        own = found.setdefault(size, {})
        own[d, e] = own.get((d, e), 0) + (v << (DIGIT * k))
    model = WhiteningModel({size: Space(size, own, components) for size, own in found.items()})
    if model.spaces:
        sent = spark.sparkContext.broadcast(model)
        measured: dict[int, dict[tuple[int, int], float]] = {}
        for size, i, j, v in distinct.mapInArrow(_moments(sent), "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect():
            measured.setdefault(size, {})[i, j] = v
        for size, own in measured.items():
            space = model.spaces[size]
            space.identity_error = max((abs(v / space.n - own[i, -1] * own[j, -1] / space.n**2 - (i == j)) for (i, j), v in own.items()
                                        if j >= 0 and space.varies[i] and space.varies[j]), default=0.0)
    shelf.drop("fit-list")
    return model


def _whiten(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _spaces(batch.column("x")):
                space = sent.value.spaces.get(x.shape[1])
                ids = batch.column("id").take(pa.array(rows))
                if space is None:
                    nothing = pa.array([[]] * len(rows), pa.list_(pa.float64()))
                    n, far, white, share, error = 0, [0] * len(rows), nothing, nothing, 0.0
                else:
                    centred = space.centred(x)
                    n, far, error = space.n, space.deviations(centred), space.identity_error
                    white, share = (pa.array(list(v), pa.list_(pa.float64())) for v in (space.whitened(centred), [space.explained] * len(rows)))
                far = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n] * len(rows), pa.int64()), far, white, share, pa.array([error] * len(rows), pa.float64())],
                                                 names=["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, model: WhiteningModel) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of ``quantized`` rows; ``whitened`` and ``explained`` have an entry
    for each component. ``deviation``, the exact sum of (n x - S)^2, is null where it has more than 38 digits."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_whiten(sent), f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
