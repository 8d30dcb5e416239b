"""Nearest neighbours under many feature subsets and all folds at once.

Rows are dealt into the cells of a grid (``best``) once, whatever the number of subsets and folds, and carry their folds and label bits with them. In a cell the
candidates of each fold are searched for each subset; what a test fold leaves out is left out when the cells of a row are put together, and there neighbours become counts of
labels, so that no row of neighbours meets a row of labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.best import dense_scan, each_cell, few_best, grid, in_order  # noqa: F401

BLOCK = 2048
STRIP_BYTES = 4 << 20
#: What goes from a cell: for a block and a subset the rows' ids, folds and label bits, and of their candidates (row, id, similarity, fold, label bits).
PARTS = {"ids": np.int64, "folds": np.int32, "bits": np.uint8, "row": np.int32, "near": np.int64, "sim": np.float64, "near_fold": np.int32, "near_bits": np.uint8}


def atoms_of(subsets: list[list[int]]) -> tuple[list[list[int]], list[list[int]]]:
    """The features of each atom (those that lie in the same subsets), and the atoms of each subset."""
    held: dict[int, list[int]] = {}
    for s, fids in enumerate(subsets):
        for f in sorted(set(fids)):
            held.setdefault(f, []).append(s)
    atoms: dict[tuple[int, ...], list[int]] = {}
    for f in sorted(held):
        atoms.setdefault(tuple(held[f]), []).append(f)
    return list(atoms.values()), [[a for a, of in enumerate(atoms) if s in of] for s in range(len(subsets))]


def _lengths(x: np.ndarray, atoms: list[list[int]], of: list[list[int]]) -> list[np.ndarray]:
    """The lengths of the rows in each subset, from the squares of the atoms."""
    squares = [(x[:, a] ** 2).sum(axis=1) for a in atoms]
    return [np.maximum(np.sqrt(sum((squares[a] for a in parts), np.zeros(len(x)))), 1e-12) for parts in of]


def _found(dealt: DataFrame, subsets: list[list[int]], cv: int, k: int) -> DataFrame:
    """(number, s, parts): for each block of rows, subset and cell the k best candidates of each fold; dealt: (id, fold, features, labels)."""
    used = sorted({f for fids in subsets for f in fids})
    place = {f: i for i, f in enumerate(used)}
    columns_of = [[place[f] for f in sorted(set(fids))] for fids in subsets]
    atoms, of = atoms_of(columns_of)
    weight = 8 * len(used) + sum(4 * len(c) + 8 for c in columns_of) + 32
    rows = dealt.select(F.lit("").alias("grp"), "id", "fold", F.transform(F.array(*map(F.lit, used)), lambda i: F.element_at("features", i + 1)).alias("features"), "labels")
    cells = grid(rows, rows, BLOCK, F.struct("id", "fold", "features", "labels"), F.lit(weight))
    columns = [F.col("held.id"), F.col("held.fold"), F.flatten("held.features"), F.flatten("held.labels")]

    def block_of(block: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, folds, x, y = (b.values.to_numpy(zero_copy_only=False) for b in block)
        return ids, folds.astype(np.int32), x.reshape(len(ids), -1), np.packbits(y.reshape(len(ids), -1) > 0, axis=1)

    def hold(blocks: list) -> tuple:
        ids, folds, x, bits = (np.concatenate(c) for c in zip(*map(block_of, blocks), strict=True))
        order = np.argsort(folds, kind="stable")
        ids, folds, x, bits = ids[order], folds[order], x[order], bits[order]
        size = _lengths(x, atoms, of)
        ends = np.searchsorted(folds, np.arange(cv + 1))
        return ids, folds, x, bits, size, [(x[:, c] / n[:, None]).astype(np.float32) for c, n in zip(columns_of, size, strict=True)], ends

    def answer(held: tuple, grp: str, number: int, block: list) -> Iterator[pa.RecordBatch]:
        c_ids, c_folds, c_x, c_bits, c_size, c_32, ends = held
        ids, folds, x, bits = block_of(block)
        size = _lengths(x, atoms, of)
        strip = max(1, STRIP_BYTES // (4 * BLOCK))
        for s, columns in enumerate(columns_of):
            q, found = x[:, columns] / size[s][:, None], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                some, some_size = c_x[a:b], c_size[s][a:b]
                row, col, sim = dense_scan(q, ids, c_ids[a:b], c_32[s][a:b], lambda at, x=some, n=some_size, c=columns: x[at][:, c] / n[at][:, None], k, strip)
                found.append((row, col + a, sim))
            row, col, sim = (np.concatenate(c) for c in zip(*found, strict=True))
            parts = dict(zip(PARTS, (ids, folds, bits, row, c_ids[col], sim, c_folds[col], c_bits[col]), strict=True))
            raw = [pa.array([np.ascontiguousarray(parts[c], PARTS[c]).tobytes()], pa.binary()) for c in PARTS]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([s], pa.int32()), *raw], ["number", "s", *PARTS])

    return each_cell(cells, columns, hold, answer, "number long, s int, " + ", ".join(f"{c} binary" for c in PARTS))


def _together(found: DataFrame, work: Callable[[int, dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on what all cells found for a block of rows and a subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                parts = {c: np.concatenate([h[c] for h in held]) if i >= 3 else held[0][c] for i, c in enumerate(PARTS)}
                n = len(parts["ids"])
                for c, m in (("bits", n), ("near_bits", len(parts["row"]))):
                    parts[c] = parts[c].reshape(m, len(parts["bits"]) // n if c == "bits" else parts["bits"].shape[1])
                yield work(at[1], parts)

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key != at:
                    yield from done()
                    at, held = key, []
                held.append({c: np.frombuffer(batch.column(2 + j)[i].as_buffer(), PARTS[c]) for j, c in enumerate(PARTS)})
        yield from done()

    n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * found.sparkSession.sparkContext.defaultParallelism)
    return found.repartition(n, "number", "s").sortWithinPartitions("number", "s").mapInArrow(run, schema)


def _of_fold(parts: dict[str, np.ndarray], t: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the candidates, similarity): the k best that aren't in the fold, in order."""
    some = np.flatnonzero(parts["near_fold"] != t)
    row, col, sim = in_order(parts["row"][some], some, parts["sim"][some], parts["near"], k, len(parts["ids"]))
    return row, col, sim


def subset_neighbours(dealt: DataFrame, subsets: dict[str, list[int]], cv: int, k: int) -> DataFrame:
    """(grp, id, near, sim, rank): per subset and test fold (grp: ``subset/fold``) the k rows outside of the fold most similar to each row, itself excluded by id.

    dealt: (id, fold, features). Similarities are rounded to 10 places; ties go to the smaller id.
    """
    names = list(subsets)
    labelled = dealt.select("id", "fold", "features", F.array(F.lit(0)).alias("labels"))

    def work(s: int, parts: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = []
        for t in range(cv):
            row, col, sim = _of_fold(parts, t, k)
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            out.append((np.full(len(row), s * cv + t, np.int32), parts["ids"][row], parts["near"][col], sim, rank.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["grp", "id", "near", "sim", "rank"])

    named = F.element_at(F.array(*(F.lit(f"{name}/{t}") for name in names for t in range(cv))), F.col("grp") + 1)
    return _together(_found(labelled, list(subsets.values()), cv, k), work, "grp int, id long, near long, sim double, rank int").withColumn("grp", named)


def subset_counts(dealt: DataFrame, subsets: list[list[int]], cv: int, k: int, label_k: np.ndarray | None = None) -> DataFrame:
    """(s, n, ids, folds, y, c): for blocks of n rows, subset by number, their ids, folds, labels and how many of the k nearest rows outside of each test fold have each label
    (rows by folds by labels; -1: there is no such row), as binary arrays of longs, ints, bytes and ints. dealt: (id, fold, features, labels); ``label_k``: how many of
    the k to look at, folds by labels."""

    def work(s: int, parts: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(parts["ids"])
        y, wide = np.unpackbits(parts["bits"], axis=1), np.unpackbits(parts["near_bits"], axis=1)
        c = np.full((n, cv, y.shape[1]), -1, np.int32)
        for t in range(cv):
            row, col, _ = _of_fold(parts, t, k)
            bits = wide[col].astype(np.int32)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            if label_k is not None and len(row):
                limits = np.zeros(y.shape[1], int)
                limits[: label_k.shape[1]] = label_k[t]
                bits *= (np.arange(len(row)) - np.searchsorted(row, row))[:, None] < limits
            if len(row):
                c[row[starts], t] = np.add.reduceat(bits, starts, axis=0)
        raw = [pa.array([v.tobytes()], pa.binary()) for v in (parts["ids"], parts["folds"], y, c)]
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([n], pa.int32()), *raw], ["s", "n", "ids", "folds", "y", "c"])

    return _together(_found(dealt, subsets, cv, k), work, "s int, n int, ids binary, folds binary, y binary, c binary")
