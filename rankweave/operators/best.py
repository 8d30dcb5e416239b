"""The best candidates of rows: cells of a grid of groups, and the search within a cell.

Rows and candidates are dealt into blocks, blocks into a few groups; each pair of groups is a cell, a task that holds its candidates and reads its asking rows as a
stream of blocks. Data moves once for each group of the other side, not for each block, and each row gets k candidates from each group of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates that are compared at a time, bytes of candidates that a task holds, and groups of them at least; asking rows of a group at least.
CHUNK = 2048
GROUP_BYTES = 128 << 20
GROUPS = 6
SMALL = 128
#: More candidates than this for each row and the chunk is put in order as a whole.
MANY = 64


def few_best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest finite similarities of each row, ties to the smaller id; equal ones beyond k are never put in order."""
    if sims.shape[1] > k:
        sims = np.where(np.isnan(sims), -np.inf, sims)
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        above, level = sims > least, sims == least
        tied = np.flatnonzero(np.count_nonzero(level, axis=1) > k)
        if len(tied):
            by_id = np.argsort(ids, kind="stable")
            some = level[tied][:, by_id]
            some &= np.cumsum(some, axis=1, dtype=np.int32) <= k
            level[tied[:, None], by_id] = some
        row, col = nonzero((above | level) & np.isfinite(sims))
    else:
        row, col = np.nonzero(np.isfinite(sims))
    return in_order(row, col, sims[row, col], ids, k, len(sims))[:2]


def nonzero(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As numpy's, faster where few are true."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def in_order(row: np.ndarray, col: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each of ``n`` rows, greatest similarity first, ties to the smaller id."""
    order = np.lexsort((ids[col], -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    kept = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < k
    return row[kept], col[kept], sim[kept]


def scan(q_id: np.ndarray, c_id: np.ndarray, k: int, strip: int, near: Callable, exact: Callable, pairs: Callable, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity): the k best candidates of each row, itself left out by id, in order.

    ``near(a, b, c, d)``: similarities of rows a to b and candidates c to d, off by ``margin`` at most; ``exact((a, b, c, d))``: those rounded; ``pairs(row, col)``: those of
    pairs, rounded. Only pairs that may pass the k-th found so far are looked at exactly.
    """
    out = []
    for a in range(0, len(q_id), strip):
        b = min(a + strip, len(q_id))
        ids, floor = q_id[a:b], np.full(b - a, -np.inf)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        waiting = 0

        def settle(found=found, floor=floor, n=b - a) -> None:
            row, col, sim = in_order(*(np.concatenate(x) for x in zip(*found, strict=True)), c_id, k, n)
            found[:] = [(row, col, sim)]
            many = np.bincount(row, minlength=n)
            full = many >= k
            floor[full] = sim[(np.cumsum(many) - 1)[full]]

        for c in range(0, len(c_id), CHUNK):
            d = min(c + CHUNK, len(c_id))
            sims = near(a, b, c, d)
            able = sims >= (floor - margin).astype(sims.dtype)[:, None]
            if np.count_nonzero(able) > MANY * (b - a):
                whole = exact((a, b, c, d))
                whole[ids[:, None] == c_id[None, c:d]] = -np.inf
                row, col = few_best(whole, c_id[c:d], k)
                sim = whole[row, col]
            else:
                row, col = nonzero(able)
                other = ids[row] != c_id[c:d][col]
                row, col = row[other], col[other]
                sim = pairs(row + a, col + c)
            fit = sim >= floor[row]
            found.append((row[fit], col[fit] + c, sim[fit]))
            waiting += int(fit.sum())
            if waiting > k * (b - a) or c == 0:
                settle()
                waiting = 0
        settle()
        row, col, sim = found[0]
        out.append((row + a, col, sim))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def dense_scan(q: np.ndarray, q_id: np.ndarray, c_id: np.ndarray, c32: np.ndarray, unit: Callable[[np.ndarray | slice], np.ndarray], k: int, strip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``scan`` of unit rows: products in single precision rule out, products in double precision decide. ``c32``: candidates in single precision, ``unit``: some of them in
    double precision."""
    q32 = q.astype(np.float32)

    def exact(tile: tuple[int, int, int, int]) -> np.ndarray:
        a, b, c, d = tile
        return np.round(q[a:b] @ unit(slice(c, d)).T, 10)

    def pairs(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", q[row], unit(col)), 10)

    return scan(q_id, c_id, k, strip, lambda a, b, c, d: q32[a:b] @ c32[c:d].T, exact, pairs, (q.shape[1] + 8) * 2.0**-23)


def grid(asked: DataFrame, candidates: DataFrame, block: int, values: Column, weight: Column) -> DataFrame:
    """(grp, side, number, held): blocks of ``block`` rows about, a partition a cell, candidates (side 0) first in it. Both have (grp, id, ...); ``held`` has the structs
    ``values`` of the block's rows, ``weight`` is how many bytes a task needs for a candidate."""
    cores = max(candidates.sparkSession.sparkContext.defaultParallelism, 1)
    of_c = candidates.groupBy("grp").agg(F.count("*").alias("n_c"), F.sum(weight).alias("bytes"))
    of_q = asked.groupBy("grp").agg(F.count("*").alias("n_q"))
    c_blocks, q_blocks = F.ceil(F.col("n_c") / block), F.ceil(F.col("n_q") / block)
    cg = F.least(F.ceil(F.col("n_c") / SMALL), F.greatest(F.lit(GROUPS).cast("long"), F.ceil(F.col("bytes") / GROUP_BYTES)))
    qg = F.least(F.ceil(F.col("n_q") / SMALL), F.lit(2 * cores).cast("long"))
    many = of_c.join(of_q, "grp").select("grp", cg.alias("cg"), qg.alias("qg"), F.greatest(c_blocks, cg).alias("c_blocks"), F.greatest(q_blocks, qg).alias("q_blocks"))

    def side(rows: DataFrame, number: int, blocks: str, own: str, other: str) -> DataFrame:
        dealt = rows.join(F.broadcast(many), "grp").withColumn("number", F.pmod(F.xxhash64("id"), F.col(blocks)))
        held = dealt.groupBy("grp", "cg", "qg", "number").agg(F.collect_list(values).alias("held"))
        mine, theirs = F.pmod(F.col("number"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        each = held.select("grp", "number", "held", "qg", mine.alias("mine"), theirs.alias("theirs"))
        cell = F.col("mine") * F.col("qg") + F.col("theirs") if number == 0 else F.col("theirs") * F.col("qg") + F.col("mine")
        return each.select("grp", cell.alias("cell"), F.lit(number).alias("side"), "number", "held")

    met = side(candidates, 0, "c_blocks", "cg", "qg").unionByName(side(asked, 1, "q_blocks", "qg", "cg"))
    most = many.agg(F.max(F.col("cg") * F.col("qg"))).first()[0] or 1
    at = F.pmod(F.col("cell") + F.xxhash64("grp") % 1009, F.lit(most)).cast("int")
    return met.repartitionById(int(most), at).sortWithinPartitions("grp", "cell", "side", "number")


def each_cell(cells: DataFrame, columns: list[Column], hold: Callable, answer: Callable, schema: str) -> DataFrame:
    """``hold`` makes of a cell's blocks of candidates what ``answer`` (held, grp, number, block) needs for each block of asking rows; blocks are Arrow scalars of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                grp, cell, side, number = (batch.column(x)[i].as_py() for x in range(4))
                block = [c[i] for c in batch.columns[4:]]
                if (grp, cell) != at:
                    at, waiting, held = (grp, cell), [], None
                if side == 0:
                    waiting.append(block)
                elif waiting or held is not None:
                    if held is None:
                        held, waiting = hold(waiting), []
                    yield from answer(held, grp, number, block)

    return cells.select("grp", "cell", "side", "number", *(c.alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, schema)
