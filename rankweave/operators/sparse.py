"""Sparse features: (size, indices, values) of what isn't zero, and products of blocks of such rows that never make dense rows.

Ranking by the embedded fit and ML-kNN take samples with either layout of ``features``; weights and similarity tiles are dense, rows are not.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankweave.functions.columns import unit

#: Numbers of a block, and products that are spread out at a time.
ELEMENTS = 1 << 20
SPREAD = 1 << 22
#: Features that at least one in so many rows of a block has are dense columns of it.
COMMON = 32


def sparse(features: Column) -> Column:
    """The sparse layout of an array; what isn't a number stays in it, null counts as zero."""
    indices = F.filter(F.sequence(F.lit(0), F.size(features) - 1), lambda i: F.coalesce(F.get(features, i), F.lit(0.0)) != 0)
    indices = F.when(F.size(features) > 0, indices).otherwise(F.array().cast("array<int>"))
    return F.struct(F.size(features).alias("size"), indices.alias("indices"), F.transform(indices, lambda i: F.get(features, i)).alias("values"))


def unit_sparse(features: Column) -> Column:
    return F.struct(features["size"].alias("size"), features["indices"].alias("indices"), unit(features["values"]).alias("values"))


def is_sparse(rows: DataFrame) -> bool:
    return isinstance(rows.schema["features"].dataType, StructType)


def products(left: np.ndarray, x: np.ndarray, first: np.ndarray, count: np.ndarray, right: np.ndarray, y: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The sums of ``x[e] * y[f]`` by (left[e], right[f]), where e meets ``count[e]`` numbers f from ``first[e]`` on."""
    out, ends = np.zeros(shape[0] * shape[1]), np.cumsum(count)
    a = 0
    while a < len(left):
        done = int(ends[a] - count[a])
        b = max(a + 1, int(np.searchsorted(ends, done + max(SPREAD, len(out)), "right")))
        e = np.repeat(np.arange(a, b), count[a:b])
        f = first[e] + np.arange(len(e)) - (ends[e] - count[e] - done)
        out += np.bincount(left[e].astype(np.int64) * shape[1] + right[f], x[e] * y[f], len(out))
        a = b
    return out.reshape(shape)


@dataclass
class SparseBlock:
    """Rows of ``d`` features: how many numbers each has, their places and the numbers. Stands in for a matrix in ``x @ v``, ``x.T @ m``."""

    d: int
    counts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    turned: bool = False

    def __post_init__(self) -> None:
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def T(self) -> SparseBlock:  # noqa: N802, as of an array
        return SparseBlock(self.d, self.counts, self.indices, self.values, not self.turned)

    def __matmul__(self, m: np.ndarray) -> np.ndarray:
        to, of, n = (self.indices, self.rows, self.d) if self.turned else (self.rows, self.indices, len(self.counts))
        if m.ndim == 1:
            return np.bincount(to, self.values * m[of], n)
        out = np.empty((n, m.shape[1]))
        for j in range(m.shape[1]):
            out[:, j] = np.bincount(to, self.values * m[of, j], n)
        return out

    def gram(self, s: np.ndarray) -> np.ndarray:
        """Features by features, rows weighted by s."""
        starts = np.cumsum(self.counts) - self.counts
        return products(self.indices, self.values * s[self.rows], starts[self.rows], self.counts[self.rows], self.indices, self.values, (self.d, self.d))

    def unit(self) -> SparseBlock:
        size = np.sqrt(np.bincount(self.rows, self.values**2, len(self.counts)))
        return SparseBlock(self.d, self.counts, self.indices, self.values / np.maximum(size, 1e-12)[self.rows])

    @functools.cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(common, dense, features, rows, values): features that one row in ``COMMON`` has, and their columns; the other numbers, ordered by feature."""
        features, places, many = np.unique(self.indices, return_inverse=True, return_counts=True)
        often = many * COMMON >= len(self.counts)
        column, here = (np.cumsum(often) - 1)[places], often[places]
        dense = np.zeros((len(self.counts), int(often.sum())))
        dense[self.rows[here], column[here]] = self.values[here]
        order = np.flatnonzero(~here)
        order = order[np.argsort(self.indices[order], kind="stable")]
        return features[often], dense, self.indices[order], self.rows[order], self.values[order]

    def times_rows_of(self, other: SparseBlock) -> np.ndarray:
        """Rows by rows of the other: features that many of the other's rows have are columns of a product of matrices, with at most ``COMMON`` places for each of the other's
        numbers; the other numbers are ordered by feature, and every number of a row meets the list of its feature."""
        common, dense, lists, rows, values = other.by_feature
        out = np.zeros((len(self.counts), len(other.counts)))
        at = np.searchsorted(common, self.indices)
        here = at < len(common)
        here[here] = common[at[here]] == self.indices[here]
        if here.any():
            mine = np.zeros((len(self.counts), len(common)))
            mine[self.rows[here], at[here]] = self.values[here]
            out += mine @ dense.T
        if len(lists):
            first = np.searchsorted(lists, self.indices, "left")
            count = np.searchsorted(lists, self.indices, "right") - first
            out += products(self.rows, self.values, first, count, rows, values, out.shape)
        return out


def row_blocks(rows: DataFrame) -> DataFrame:
    """(n, x, y, s, d, indices, counts): blocks of sparse rows (features, labels, s) as binary arrays, of about ``ELEMENTS`` numbers that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, indices, values = batch.column(0).flatten()
            counts = np.diff(indices.offsets.to_numpy()).astype(np.int64)
            at, x = (c.flatten().to_numpy(zero_copy_only=False) for c in (indices, values))
            y = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) > 0).astype(np.int8)
            s, ends = batch.column(2).to_numpy(zero_copy_only=False), np.cumsum(counts)
            a = 0
            while a < len(s):
                done = int(ends[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(ends, done + ELEMENTS, "right")))
                some = slice(done, int(ends[b - 1]))
                held = [x[some].astype(float), y[a:b], s[a:b].astype(float)], [at[some].astype(np.int32), counts[a:b]]
                left, right = ([pa.array([v.tobytes()], pa.binary()) for v in part] for part in held)
                yield pa.RecordBatch.from_arrays([pa.array([b - a], pa.int32()), *left, pa.array([size[a].as_py()], pa.int32()), *right], ["n", "x", "y", "s", "d", "indices", "counts"])
                a = b

    return rows.select("features", "labels", "s").mapInArrow(run, "n int, x binary, y binary, s binary, d int, indices binary, counts binary")


def block_of(d: int, counts: pa.Scalar, indices: pa.Scalar, x: pa.Scalar) -> SparseBlock:
    return SparseBlock(d, np.frombuffer(counts.as_buffer(), np.int64), np.frombuffer(indices.as_buffer(), np.int32), np.frombuffer(x.as_buffer()))
