"""Nearest neighbours by cosine similarity.

Asking rows meet candidates in the cells of a grid (``best``), each a task that holds some candidates; products rule most of them out, and only the k best of each cell go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.best import CHUNK, dense_scan, each_cell, grid, scan
from rankweave.operators.sparse import SparseBlock, is_sparse

BLOCK = 2048
STRIP = 512
FOUND = "grp string, id long, near long, sim double"


def unit_rows(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.sqrt((values * values).sum(axis=1, keepdims=True)), 1e-12)


def numbers(values: pa.Scalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False)


def knn(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(grp, id, near, sim, rank): for each query of a group its k most similar candidates of the group, itself excluded by id.

    Both have (grp, id, features), features of one layout (an array, or sparse). Similarities are rounded to 10 places; ties go to the smaller id.
    """
    sparse = is_sparse(candidates)
    weight = 24 * F.size("features.indices") + 64 if sparse else 12 * F.size("features") + 64
    cells = grid(queries, candidates, BLOCK, F.struct("id", "features"), weight)
    features = F.col("held.features")
    columns = [features["size"], F.transform(features["indices"], F.size), F.flatten(features["indices"]), F.flatten(features["values"])] if sparse else [F.flatten("held.features")]

    def batch(grp: str, q_id: np.ndarray, c_id: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        row, col, sim = found
        return pa.RecordBatch.from_arrays([pa.array([grp] * len(row), pa.string()), pa.array(q_id[row]), pa.array(c_id[col]), pa.array(sim)], ["grp", "id", "near", "sim"])

    def hold(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c_id, x = np.concatenate([numbers(b[0]) for b in blocks]), np.concatenate([numbers(b[1]) for b in blocks])
        unit = unit_rows(x.reshape(len(c_id), -1))
        return c_id, unit, unit.astype(np.float32)

    def answer(held: tuple, grp: str, number: int, block: list) -> Iterator[pa.RecordBatch]:
        (c_id, unit, c32), q_id = held, numbers(block[0])
        q = unit_rows(numbers(block[1]).reshape(len(q_id), -1))
        yield batch(grp, q_id, c_id, dense_scan(q, q_id, c_id, c32, lambda at: unit[at], k, STRIP))

    def unit_block(block: list) -> SparseBlock:
        size = numbers(block[1])
        return SparseBlock(int(size.max()), *(numbers(x) for x in block[2:])).unit()

    def hold_sparse(blocks: list) -> tuple[np.ndarray, list[SparseBlock]]:
        c_id, size = (np.concatenate([numbers(b[i]) for b in blocks]) for i in (0, 1))
        counts, indices, values = (np.concatenate([numbers(b[i]) for b in blocks]) for i in (2, 3, 4))
        ends = np.concatenate([[0], np.cumsum(counts)])
        chunks = [(ends[at], ends[min(at + CHUNK, len(c_id))], counts[at : at + CHUNK]) for at in range(0, len(c_id), CHUNK)]
        return c_id, [SparseBlock(int(size.max()), n, indices[a:b], values[a:b]).unit() for a, b, n in chunks]

    def answer_sparse(held: tuple, grp: str, number: int, block: list) -> Iterator[pa.RecordBatch]:
        (c_id, chunks), q_id, q = held, numbers(block[0]), unit_block(block)
        last: list[np.ndarray] = []

        def near(a: int, b: int, c: int, d: int) -> np.ndarray:
            last[:] = [q.times_rows_of(chunks[c // CHUNK])]
            return last[0]

        yield batch(grp, q_id, c_id, scan(q_id, c_id, k, len(q_id), near, lambda tile: np.round(last[0], 10), lambda row, col: np.round(last[0][row, col % CHUNK], 10), 1e-10))

    found = each_cell(cells, [F.col("held.id"), *columns], hold_sparse if sparse else hold, answer_sparse if sparse else answer, FOUND)
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.desc("sim"), "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
