"""Operator 11: embedding whitening from a bit-sliced scatter.

A component c becomes the whole number x = floor(64 c) + 1000000.  The cross-products of all dimensions are counted, not multiplied:

* a task takes its rows batch by batch, shifts each dimension by its smallest value there, and packs every bit plane of the
  shifted values across rows into 64-bit words, 64 rows to a word;
* plane a of one dimension AND plane b of another, counted and weighted with 2^(a+b), sum to the exact cross-product; the shift is
  added back in whole numbers, and one row per pair of dimensions and task crosses the shuffle;
* Spark sums these rows (two decimal limbs each, so that no sum can overflow), and the driver gets the width x width matrix.
  It is centred as integers, n * XX - S S', divided once by n^2, and only then handed to ``eigh``.

The whitened rows are made by a second pass that gets the eigenvectors (32 x width numbers); a third pass over the same rows sums
the whitened covariance, so that ``identity_error`` is measured on all rows and not derived.  No pass shuffles vectors.

Defined results: vectors that are null or hold null or non-finite entries are left out of the fit and of the result; a shorter
vector counts as filled up with entries of zero; |64 c| beyond 2^62 counts as 2^62.  Rows with a null vec_id and repeated rows take part,
each as a row of its own.  Components whose eigenvalue is not above rounding (equal columns, fewer rows than columns, a single
row) are not returned, so a table without any spread, like an empty one, gives no rows; equal eigenvalues give some orthonormal basis of their space.
A deviation beyond 64 bits becomes the largest bigint.  Further columns of the input are ignored.
"""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import table
from dialogscope.llm.maxscore import valid

OFFSET = 1_000_000
SCALE = 64
COMPONENTS = 32
BATCH = 8_192
LIMIT = 1 << 62
LIMB = 10 ** 18
NOISE = 100 * np.finfo(float).eps


def whole(lists: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of every entry as rows of ``width`` numbers."""
    offsets = np.asarray(lists.offsets)
    sizes = np.diff(offsets)
    values = np.asarray(lists.values, dtype=np.float64)[offsets[0]:offsets[-1]] if len(lists) else np.empty(0)
    out = np.zeros((len(sizes), width), np.int64)
    with np.errstate(over="ignore"):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
            np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)
    return out


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit planes of non-negative columns: (words of 64 rows, dimension of each plane, its bit)."""
    n, width = shifted.shape
    padded = np.zeros((-(-n // 64) * 64, width), np.uint64)
    padded[:n] = shifted
    top = [int(v).bit_length() for v in padded.max(axis=0, initial=0)]
    planes, dims, bits = [], [], []
    for bit in range(max(top, default=0)):
        held = [d for d in range(width) if top[d] > bit]
        ones = ((padded[:, held] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T
        planes.append(np.packbits(ones, axis=1).view(np.uint64))
        dims += held
        bits += [bit] * len(held)
    return np.concatenate(planes) if planes else np.empty((0, len(padded) // 64), np.uint64), np.array(dims, np.int64), np.array(bits, np.int64)


def cross_products(shifted: np.ndarray) -> np.ndarray:
    """The exact matrix of sum(y_d * y_e) over the rows, by weighted counts of ANDed bit planes."""
    n, width = shifted.shape
    planes, dims, bits = bit_planes(shifted)
    long = 2 * (int(bits.max(initial=0)) + 1) + n.bit_length() < 62
    out = np.zeros((width, width), np.int64 if long else object)
    weight = np.int64(1) << bits if long else np.array([1 << int(b) for b in bits], object)
    for p in range(len(planes)):
        counts = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
        if not long:
            counts = counts.astype(object)
        counts = counts * weight[p:] * weight[p]
        np.add.at(out, (dims[p], dims[p:]), counts)
        np.add.at(out, (dims[p + 1:], dims[p]), counts[1:])
    return out


class Scatter:
    """Exact sums and cross-products of rows of whole numbers, added batch by batch."""

    def __init__(self, width: int):
        self.n, self.sums, self.products = 0, np.zeros(width, object), np.zeros((width, width), object)

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        low = rows.min(axis=0)
        shifted = rows.astype(np.uint64) - low.astype(np.uint64)  # differences fit 64 bits without a sign
        own = cross_products(shifted).astype(object)
        if int(shifted.max(initial=0)).bit_length() + len(rows).bit_length() < 63:
            sums = shifted.astype(np.int64).sum(axis=0).astype(object)
        else:
            sums = shifted.astype(object).sum(axis=0)
        low, n = low.astype(object), len(rows)
        self.n += n
        self.sums += sums + n * low
        self.products += own + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            some = batch.slice(at, BATCH)
            yield some, some.column(column)


def _scatter(width: int):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Scatter(width)
        for _, vectors in _batches(batches, 0):
            held.add(whole(vectors, width))
        if held.n:
            i, j = np.triu_indices(width)
            found = [*held.products[i, j], *held.sums, held.n]
            parts = [divmod(int(v), LIMB) for v in found]
            at = [np.append(i, [*range(width), -1]), np.append(j, [-1] * (width + 1))]
            yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), *(pa.array([Decimal(p[k]) for p in parts], pa.decimal128(38)) for k in (0, 1))],
                                             ["i", "j", "high", "low"])
    return scatter


class Whitening:
    """What the fit found: n, the sums, and the components by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS):
        width = len(sums)
        covariance = np.array([[(n * products[d][e] - sums[d] * sums[e]) / n ** 2 for e in range(width)] for d in range(width)]).reshape(width, width)
        values, vectors = np.linalg.eigh(covariance) if width else (np.empty(0), np.empty((0, 0)))
        kept = [k for k in np.argsort(-values, kind="stable") if values[k] > max(values) * width * NOISE][:components]
        self.n, self.sums, self.trace = n, sums, float(np.trace(covariance))
        self.values, self.vectors = values[kept], vectors[:, kept]
        self.explained = [float(v) / self.trace for v in self.values]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S as whole numbers."""
        n, most = self.n, max([abs(s) for s in self.sums], default=0)
        if n * int(np.abs(rows).max(initial=0)) + most < 1 << 62:
            return n * rows - np.array(self.sums, np.int64)
        return n * rows.astype(object) - np.array(self.sums, object)

    def deviation(self, centred: np.ndarray) -> list[int]:
        top = int(np.abs(centred).max(initial=0))
        exact = centred if top * top * max(1, centred.shape[1]) < 1 << 62 else centred.astype(object)
        return [min(int(v), (1 << 63) - 1) for v in (exact * exact).sum(axis=1)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        unrounded = (centred / self.n).astype(np.float64)
        return unrounded @ (self.vectors / np.sqrt(self.values))


def _whitened(shared, width: int):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for batch, vectors in _batches(batches, 1):
            centred = fit.centred(whole(vectors, width))
            rows = fit.whitened(centred)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fit.deviation(centred), pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], ["vec_id", "deviation", "whitened"])
    return whitened


def _covariance(shared, width: int):
    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, n, k = shared.value, 0, len(shared.value.values)
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, vectors in _batches(batches, 0):
            rows = fit.whitened(fit.centred(whole(vectors, width)))
            n, sums, products = n + len(rows), sums + rows.sum(axis=0), products + rows.T @ rows
        if n:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, range(k)), pa.int32()), pa.array(np.append(j, [-1] * k), pa.int32()),
                                              pa.array(np.append(products[i, j], sums))], ["i", "j", "total"])
    return covariance


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.where(valid(F.col("vector")))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of all rows of (vec_id, vector), and the vectors' width; None where there are no rows."""
    rows = usable(vectors)
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return None, 0
    found = (rows.select("vector").mapInArrow(_scatter(width), "i int, j int, high decimal(38,0), low decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())  # width^2 / 2 + width + 1 rows
    total = {(r.i, r.j): int(r.high) * LIMB + int(r.low) for r in found}
    products = [[total[min(d, e), max(d, e)] for e in range(width)] for d in range(width)]
    return Whitening(total[-1, -1], [total[d, -1] for d in range(width)], products, components), width


def identity_error(vectors: DataFrame, fitted: Whitening, width: int) -> float:
    """The largest absolute entry of the whitened rows' covariance, measured over all rows, minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)
    found = usable(vectors).select("vector").mapInArrow(_covariance(shared, width), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = {(r.i, r.j): r.total / fitted.n for r in found}
    return max((abs(v - total[i, -1] * total[j, -1] - (i == j)) for (i, j), v in total.items() if j >= 0), default=0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component."""
    spark, (fitted, width) = vectors.sparkSession, fit(vectors, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shared = spark.sparkContext.broadcast(fitted)
    rows = usable(vectors).select(F.col("vec_id").cast("bigint"), "vector").mapInArrow(_whitened(shared, width), "vec_id bigint, deviation bigint, whitened array<double>")
    error = identity_error(vectors, fitted, width)
    explained = F.array(*map(F.lit, fitted.explained))
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", F.col("value").alias("whitened"),
                    F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
