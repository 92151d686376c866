"""Whitening of vectors from exact integer cross-products.

Entries become integers. A block of rows is turned on its side: every dimension, shifted by the block's smallest value so that
it is not negative, is cut into bit planes, and each plane is packed across rows into 64-bit words. The cross-product of two
dimensions is the sum over pairs of planes of popcount(plane and plane), weighted by powers of two, so it is exact; the
shift is taken back with the blocks' sums. Tasks add blocks up and give one row per pair of dimensions; Spark adds those as
decimals. The driver gets the sums (dimensions squared numbers, whatever the number of rows), centres them as integers
(n * sum of products - product of sums) and only then goes to doubles for the eigenvectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
ROWS = 4096  # of a block: 64 words a plane
LIMB = 24  # bits; sums of products of two limbs over a block stay below 2^60
LARGEST = float(1 << 52)  # scaled entries beyond are cut to this


@dataclass
class Model:
    """Rows, sums per dimension, unit eigenvectors (columns) by falling eigenvalue, the eigenvalues, and their whole sum."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers to rows of whitened components; nan where the eigenvalue is nothing."""
        centred = self.spread(x).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(self.values), math.nan)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        if self.n * (abs(x).max(initial=0) + 1) < 1 << 62 and max(map(abs, self.sums)) < 1 << 62:
            return x * self.n - np.array(self.sums)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int]:
        d = self.spread(x)
        if d.dtype != object and int(abs(d).max(initial=0)) ** 2 * max(1, x.shape[1]) >= 1 << 62:
            d = d.astype(object)
        return [int(v) for v in (d * d).sum(axis=1)]


def integers(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part and their integers (rows x dims). A row takes part if its vector has `dims` entries, all of them finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims) if dims else np.zeros(0, np.int64)
    c = values[(np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(dims)]
    fine = np.isfinite(c).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[fine], np.floor(np.clip(c[fine] * SCALE, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (planes x words) and each plane's column and bit, of integers that are not negative (rows x columns)."""
    bits = [int(v).bit_length() for v in y.max(axis=0)]
    column, bit = np.repeat(np.arange(y.shape[1]), bits), np.concatenate([np.arange(b) for b in [0, *bits]]).astype(np.int64)
    turned = np.ascontiguousarray(y.T)
    words = np.zeros((len(column), -(-len(y) // 64) * 8), np.uint8)
    for k, (c, b) in enumerate(zip(column.tolist(), bit.tolist())):
        packed = np.packbits((turned[c] >> b) & 1 != 0)
        words[k, :len(packed)] = packed
    return words.view(np.uint64), column, bit


def plane_products(y: np.ndarray) -> np.ndarray:
    """Sums over rows of products of columns, all below 2^LIMB: weighted and-popcounts of their planes."""
    words, column, bit = bit_planes(y)
    out = np.zeros((y.shape[1], y.shape[1]), np.int64)
    if not len(column):
        return out
    edges = np.flatnonzero(np.r_[True, np.diff(column) > 0])  # first plane of each column that has any
    for at, first in enumerate(edges.tolist()):
        others, starts = column[edges[at:]], edges[at:] - first
        for k in range(first, int(edges[at + 1]) if at + 1 < len(edges) else len(column)):
            counts = np.bitwise_count(words[k] & words[first:]).sum(axis=1, dtype=np.int64)
            out[column[first], others] += np.add.reduceat(counts << bit[first:], starts) << bit[k]
    return np.triu(out) + np.triu(out, 1).T


def block_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of columns and of products of columns (symmetric) of a block of integers; arrays of Python integers."""
    low, dims = x.min(axis=0), x.shape[1]
    y = x - low
    limbs = max(1, -(-int(y.max()).bit_length() // LIMB))
    cut = np.concatenate([(y >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(limbs)], axis=1)
    scale = np.array([1 << (LIMB * k) for k in range(limbs)], object)
    sums = scale @ cut.sum(axis=0).reshape(limbs, dims).astype(object)
    parts = plane_products(cut).reshape(limbs, dims, limbs, dims).astype(object)
    products = sum(parts[a, :, b, :] * (scale[a] * scale[b]) for a in range(limbs) for b in range(limbs))
    shift, n = low.astype(object), len(x)
    cross = np.multiply.outer(shift, sums)
    return sums + n * shift, products + cross + cross.T + n * np.multiply.outer(shift, shift)


def _rows(batches, dims: int):
    """Blocks of a task's integers, with the ids they belong to."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, x = integers(part.column(1), dims)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), x


def dimensions(vectors: DataFrame, vector: str) -> int:
    """The commonest length of vectors that are there, not empty and hold only finite numbers (of several, the largest); 0 if there are none."""
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(math.inf))
    size = F.size(F.col(vector))
    fine = vectors.filter((size > 0) & F.forall(vector, x))
    top = fine.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all rows that take part (see integers); None if there are none."""
    dims = dimensions(vectors, vector)
    if not dims:
        return None
    pairs = np.triu_indices(dims)

    def scatter(batches):
        n, sums, products = 0, 0, 0
        for _, x in _rows(batches, dims):
            s, p = block_products(x)
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            i, j = np.r_[-2, np.full(dims, -1), pairs[0]], np.r_[0, np.arange(dims), pairs[1]]
            total = pa.array([Decimal(int(v)) for v in [n, *sums, *products[pairs]]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), total], ["i", "j", "total"])

    found = vectors.select(F.lit(0).alias("_"), F.col(vector)).mapInArrow(scatter, "i int, j int, total decimal(38,0)")
    got = {(r["i"], r["j"]): int(r["total"]) for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).toLocalIterator()}
    n, sums = got[-2, 0], [got[-1, j] for j in range(dims)]
    v = np.zeros((dims, dims))
    for i, j in zip(*(a.tolist() for a in pairs)):
        v[i, j] = v[j, i] = (n * got[i, j] - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:min(components, dims)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    values = np.where(values > trace * dims * 1e-14, values, 0.0)  # what is left of zero after rounding is zero
    return Model(n, sums, axes, values, trace)


def identity_error(vectors: DataFrame, model: Model, vector: str) -> float:
    """The largest entry of the covariance of the whitened rows (all rows, divisor n, centred) minus the identity; components without variance are left out."""
    dims, k = len(model.sums), len(model.values)
    live = np.flatnonzero(model.values > 0)

    def moments(batches):
        total = np.zeros((k + 1, k))
        for _, x in _rows(batches, dims):
            w = model.whiten(x)
            total += np.vstack([w.sum(axis=0), w.T @ w])
        cells = [(i, j, Decimal(repr(float(total[i, j])))) for i in [0, *(live + 1).tolist()] for j in live.tolist() if total.any()]
        if cells:
            i, j, v = zip(*cells)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([d.quantize(Decimal(1).scaleb(-18)) for d in v], pa.decimal128(38, 18))], ["i", "j", "total"])

    found = vectors.select(F.lit(0).alias("_"), F.col(vector)).mapInArrow(moments, "i int, j int, total decimal(38,18)")
    got = {(r["i"], r["j"]): float(r["total"]) for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    mean = {j: got.get((0, j), 0.0) / model.n for j in live.tolist()}
    off = [abs(got.get((i + 1, j), 0.0) / model.n - mean[i] * mean[j] - (i == j)) for i in live.tolist() for j in live.tolist()]
    return max(off, default=0.0)


_SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row per vector that takes part and component: key, component (from 1), n, deviation (exact), whitened, explained, identity_error.

    A null vector, one with a null or non-finite entry and an empty one take no part; nor does one whose length is not the commonest.
    Scaled entries beyond 2^52 are cut to that. Repeated rows and equal or null keys count as rows of their own, other
    columns are ignored. Where vectors have no variance left, the component's whitened value is null and explained 0.
    An empty table, or one without a vector that takes part, gives no rows."""
    model = fit(vectors, vector, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    error, dims = identity_error(vectors, model, vector), len(model.sums)
    explained = model.values / model.trace if model.trace > 0 else model.values
    k = len(model.values)

    def run(batches):
        for ids, x in _rows(batches, dims):
            w = model.whiten(x).ravel()
            often = pa.array(np.repeat(np.arange(len(x)), k))
            spread = pa.array([Decimal(d) for d in model.deviation(x)], pa.decimal128(38, 0))
            many = len(w)
            yield pa.RecordBatch.from_arrays(
                [ids.take(often), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(many, model.n), pa.int64()), spread.take(often),
                 pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))], [c.split()[0] for c in _SCHEMA.split(", ")])

    return vectors.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(run, _SCHEMA)
