"""The embedded scores: group-sparse regression of label targets on features by accelerated proximal gradients.

Every sum over rows is one distributed pass of block sums. Weights (features by targets) of up to ``DRIVER_WEIGHTS`` numbers stay with the driver; larger
ones stay in blocks of features (``sharded``), with the same steps. With up to ``GRAM_FEATURES`` features the Gram matrix is made, once; without the logistic part all
steps follow from it. With more features nothing as large as features by features is made: the power iteration and the gradients are passes of X'(S(X v)).
With up to ``DENSE_LABELS`` labels their Gram matrix is taken apart on the driver, with more a range finder takes passes over the label patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import sharded, sparse
from rankweave.operators.sparse import SparseBlock, block_of, is_sparse
from rankweave.operators.weights import label_gram, pattern_counts, tail_weights, weighted
from rankweave.plans.params import EmbeddedParams, params_of
from rankweave.sources.samples import sizes

PARTIALS = 64
ROWS_AT_ONCE = 20_000
#: What stays with the driver: features of a Gram matrix (8 MB), numbers of the weights (32 MB), labels of a Gram matrix (2 MB).
GRAM_FEATURES = 1024
DRIVER_WEIGHTS = 1 << 22
DENSE_LABELS = 512
#: Features of a block of sharded weights.
FEATURE_BLOCK = 1024
#: The range finder's further directions, its accuracy relative to the greatest eigenvalue, and its passes at most.
MORE_DIRECTIONS, ACCURACY, PASSES = 10, 1e-11, 300


def block_sums(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], parts: int | None = None) -> np.ndarray:
    """The sum over all rows (features, labels, s), of either layout, or over blocks of them (``row_blocks``), of ``work`` on blocks; partial sums meet in fewer and fewer
    tasks before the driver. ``parts``: how many partitions the rows have, where that is known."""
    if "x" not in rows.columns and is_sparse(rows):
        rows = row_blocks(rows)
    in_blocks, in_sparse = "x" in rows.columns, "indices" in rows.columns

    def blocks(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if in_sparse:
            for n, x, y, s, d, indices, counts in zip(part.column(0).to_pylist(), *(part.column(i) for i in range(1, 7)), strict=True):
                yield block_of(d.as_py(), counts, indices, x), np.frombuffer(y.as_buffer(), np.int8).astype(float).reshape(n, -1), np.frombuffer(s.as_buffer())
            return
        if in_blocks:
            for n, x, y, s in zip(part.column(0).to_pylist(), *(part.column(i) for i in (1, 2, 3)), strict=True):
                yield np.frombuffer(x.as_buffer()).reshape(n, -1), np.frombuffer(y.as_buffer(), np.int8).astype(float).reshape(n, -1), np.frombuffer(s.as_buffer())
            return
        for at in range(0, part.num_rows, ROWS_AT_ONCE):
            b = part.slice(at, ROWS_AT_ONCE)
            x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) for i in (0, 1))
            yield x, y, b.column(2).to_numpy()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for x, y, s in blocks(part):
                got = work(x, y, s)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            got = np.stack([v.values.to_numpy() for v in part.column(0)]).sum(axis=0) if part.num_rows else None
            total = got if total is None else total if got is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    sums = rows.mapInArrow(run, "v array<double>")
    parts = parts or n_partitions(rows)
    while parts > PARTIALS:
        parts = -(-parts // PARTIALS)
        sums = sums.repartition(parts).mapInArrow(add, "v array<double>")
    return np.sum([np.array(r["v"]) for r in sums.collect()], axis=0)


def row_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (features, labels, s) in the layout that they have."""
    return sparse.row_blocks(rows) if is_sparse(rows) else sharded.row_blocks(rows)


def n_partitions(rows: DataFrame) -> int:
    return rows.rdd.getNumPartitions()


def prepared(samples: DataFrame, p: EmbeddedParams) -> DataFrame:
    """(features, labels, s)."""
    if not p.use_instance_weights:
        return samples.select("features", "labels", F.lit(1.0).alias("s"))
    return weighted(samples, p.inst.gamma, p.inst.kappa, p.inst.s_max).select("features", "labels", "s")


def gram(rows: DataFrame, d: int, parts: int | None = None) -> np.ndarray:
    """Features by features, weighted."""
    return block_sums(rows, lambda x, y, s: (x.gram(s) if isinstance(x, SparseBlock) else (x * s[:, None]).T @ x).ravel(), parts).reshape(d, d)


def greatest_eigenvalue(g: np.ndarray, n_iter: int = 25, seed: int = 0) -> float:
    """By power iteration from a seeded start; 0 where the matrix gives a vector of no length."""
    v = np.random.default_rng(seed).standard_normal(len(g))
    v /= np.linalg.norm(v) + 1e-12
    for _ in range(n_iter):
        u = g @ v
        size = np.linalg.norm(u)
        if size <= 1e-12:
            return 0.0
        v = u / size
    return float(v @ g @ v)


def matrix_free_eigenvalue(rows: DataFrame, d: int, n_iter: int = 25, seed: int = 0, parts: int | None = None) -> float:
    """That of the Gram matrix, which is never made: each step is a pass of X'(S(X v)), and tasks and the driver hold vectors as long as a row."""
    v = np.random.default_rng(seed).standard_normal(d)
    v /= np.linalg.norm(v) + 1e-12

    def times(v: np.ndarray) -> np.ndarray:
        return block_sums(rows, lambda x, y, s: x.T @ (s * (x @ v)), parts)

    u = times(v)
    for _ in range(n_iter):
        size = np.linalg.norm(u)
        if size <= 1e-12:
            return 0.0
        v = u / size
        u = times(v)
    return float(v @ u)


def shrink_rows(w: np.ndarray, least: float, eps: float = 1e-12) -> np.ndarray:
    """Every row shortened by ``least``, to zero at most."""
    size = np.linalg.norm(w, axis=1, keepdims=True)
    return w * np.maximum(0.0, 1 - least / (size + eps))


def label_directions(counts: DataFrame, weights: np.ndarray, r: int, seed: int = 0) -> np.ndarray:
    """The ``r`` leading directions of the weighted labels of patterns (labels, n), by a randomised range finder: a pass multiplies all patterns with an
    orthonormal basis of ``r`` and some more directions, which is then made orthonormal again. It ends when the leading directions are eigenvectors up to
    ``ACCURACY``, so no matrix of labels by labels is made."""
    k = min(len(weights), r + MORE_DIRECTIONS)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(weights), k)))[0]
    rows = sharded.row_blocks(counts.select(F.col("labels").alias("features"), "labels", F.col("n").cast("double").alias("s"))).persist(StorageLevel.MEMORY_AND_DISK)
    parts = n_partitions(rows)

    def times(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
            y = y * weights
            return (y.T @ (s[:, None] * (y @ q))).ravel()

        return block_sums(rows, work, parts).reshape(q.shape)

    try:
        for _ in range(PASSES):
            gq = times(q)
            t = q.T @ gq
            values, turn = np.linalg.eigh((t + t.T) / 2)
            turn, values = turn[:, ::-1][:, :r], values[::-1]
            off = np.linalg.norm(gq @ turn - q @ (turn * values[:r]), axis=0).max()
            if off <= ACCURACY * max(values[0], 1e-300):
                break
            q = np.linalg.qr(gq)[0]
    finally:
        rows.unpersist()
    return q @ turn


def embedding(samples: DataFrame, rank: int, label_gamma: float, n: int, n_labels: int, dense_labels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(V, label weights): the leading directions of the weighted labels; each direction's largest entry is positive."""
    weights = np.zeros(n_labels)
    for row in tail_weights(samples, label_gamma).collect():
        weights[row["lid"]] = row["weight"]
    r = max(1, min(rank, n_labels, n))
    if n_labels > (DENSE_LABELS if dense_labels is None else dense_labels):
        v = label_directions(pattern_counts(samples), weights, r)
    else:
        g = np.zeros((n_labels, n_labels))
        for x in label_gram(samples).collect():
            g[x["l1"], x["l2"]] = x["n"]
        v = np.linalg.eigh(g * np.outer(weights, weights))[1][:, ::-1][:, :r]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(r)] < 0, -1.0, 1.0), weights


@dataclass(frozen=True)
class Problem:
    """What stays the same over all steps."""

    p: EmbeddedParams
    v: np.ndarray
    label_weights: np.ndarray
    s_sum: float
    step_w: float
    step_b: float


def gradient_sums(problem: Problem, z: np.ndarray, z_bias: np.ndarray, w: np.ndarray, bias: np.ndarray) -> Callable:
    """A block's sums: gradient of the regression, of the logistic part, of the bias at (z, z_bias); squared error and cross entropy at (w, bias)."""
    p, v, lw = problem.p, problem.v, problem.label_weights

    def work(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        y = (y > 0).astype(float)
        t = (y * lw) @ v
        xz = x @ z
        g = (1 - p.alpha) * (x.T @ (s[:, None] * (xz - t)))
        e_sum = np.zeros(len(lw))
        xw = x @ w
        loss = [float((s[:, None] * (xw - t) ** 2).sum()), 0.0]
        if p.alpha > 0:
            logits = xz @ v.T + z_bias
            e = s[:, None] * (0.5 * (1 + np.tanh(logits / 2)) - y)
            g += p.alpha * (x.T @ (e @ v))
            e_sum = e.sum(axis=0)
            at_w = xw @ v.T + bias
            loss[1] = float((s[:, None] * (np.maximum(at_w, 0) + np.log1p(np.exp(-np.abs(at_w))) - y * at_w)).sum())
        return np.concatenate([g.ravel(), e_sum, loss])

    return work


def objective(problem: Problem, w: np.ndarray, loss: np.ndarray) -> float:
    return penalised(problem, float(np.linalg.norm(w, axis=1).sum()), float((w * w).sum()), loss)


def penalised(problem: Problem, lengths: float, squares: float, loss: np.ndarray) -> float:
    """The objective from the sums of the lengths of the weights' rows and of the weights' squares."""
    p, r, n_labels = problem.p, problem.v.shape[1], len(problem.label_weights)
    return (1 - p.alpha) * 0.5 * loss[0] / max(problem.s_sum * r, 1.0) + p.alpha * loss[1] / max(problem.s_sum * n_labels, 1.0) + p.beta * lengths + p.rho * squares


def step_sizes(p: EmbeddedParams, eig: float, s_sum: float) -> tuple[float, float]:
    """Of the weights and of the bias."""
    return 0.9 / max(((1 - p.alpha) + p.alpha / 4) * eig + 2 * p.rho, 1e-12), 0.9 / (p.alpha / 4 * s_sum + 1e-12)


class Course:
    """What both ways of keeping the weights share: momentum, bias, which steps are judged, and when to stop."""

    def __init__(self, problem: Problem):
        self.problem, self.t, self.losses, self.steps = problem, 1.0, [], 0
        self.bias = np.zeros(len(problem.label_weights))
        self.z_bias = self.bias

    def ahead(self, e_sum: np.ndarray) -> float:
        """Takes the step of the bias, and gives how far the next point lies beyond the step."""
        p = self.problem.p
        new = self.z_bias - self.problem.step_b * p.alpha * e_sum if p.alpha > 0 else self.z_bias
        self.t, last = (1 + np.sqrt(1 + 4 * self.t * self.t)) / 2, self.t
        beyond = (last - 1) / self.t
        self.z_bias, self.bias = new + beyond * (new - self.bias), new
        self.steps += 1
        return beyond

    @property
    def judged(self) -> bool:
        return self.steps == 1 or self.steps % 10 == 0

    @property
    def at_end(self) -> bool:
        """Whether neither a gradient nor a loss is needed any more."""
        return self.steps == self.problem.p.max_iter and not self.judged

    def settled(self, loss: float) -> bool:
        self.losses.append(loss)
        return len(self.losses) > 1 and abs(self.losses[-2] - self.losses[-1]) / max(abs(self.losses[-2]), 1e-12) < self.problem.p.tol


def _in_blocks(rows: DataFrame, p: EmbeddedParams, d: int, v: np.ndarray, lw: np.ndarray, start: np.ndarray | None, block: int, n: int) -> tuple[DataFrame, Course, float]:
    """(fid, w, score), what was done, and the greatest eigenvalue, with weights in blocks of features."""
    spark, r = rows.sparkSession, v.shape[1]
    tiles = sharded.tiled(rows, d, len(lw), block, n)
    s_sum = float(sharded.mapped(tiles.rows.select("s"), lambda raw: {"s": float(np.frombuffer(raw).sum())}, "s double").agg(F.sum("s")).first()[0])
    first = np.random.default_rng(p.seed).standard_normal(d)  # one number a feature, as in the other way
    eig = sharded.greatest_eigenvalue(tiles, p.power_iter, sharded.blocks_of(spark, tiles, lambda at, k: first[at : at + k]))
    course = Course(Problem(p, v, lw, s_sum, *step_sizes(p, eig, s_sum)))
    seed = p.seed
    begin = (lambda at, k: 0.01 * np.random.default_rng([seed, at]).standard_normal((k, r))) if start is None else (lambda at, k: start[at : at + k])
    steps = sharded.Steps.at(tiles, course.problem, sharded.blocks_of(spark, tiles, begin))
    gradient, e_sum, _ = steps.sums(course.z_bias, course.bias)
    for _ in range(p.max_iter):
        steps.step(gradient, course.ahead(e_sum))
        if course.at_end:
            break
        gradient, e_sum, loss = steps.sums(course.z_bias, course.bias)
        if course.judged and course.settled(penalised(course.problem, *steps.penalties(), loss)):
            break
    return steps.weights(), course, eig


def fit_embedded(samples: DataFrame, params: EmbeddedParams | dict | None = None, start: np.ndarray | None = None, feature_block: int | None = None) -> tuple[DataFrame, dict]:
    """The ranking (rank, fid, score; fid from 1) and a dict with the scores, the weights and what was done. With ``feature_block``, or where features by
    targets are too many for the driver, weights stay in blocks of so many features, and ``weights`` is a DataFrame (fid, w, score)."""
    from rankweave.operators.fusion import ranking

    p = params_of(EmbeddedParams, params)
    if feature_block:
        samples = sharded.checkpointed(samples)  # several passes read them before there are tiles
    n, d, n_labels = sizes(samples)
    v, lw = embedding(samples, p.rank, p.label_gamma, n, n_labels)
    r = v.shape[1]
    facts = {"n": n, "d": d, "L": n_labels, "rank": r, "alpha": p.alpha, "beta": p.beta, "rho": p.rho, "label_gamma": p.label_gamma, "instance_weights": p.inst if p.use_instance_weights else None, "V": v}
    if feature_block or d * r > DRIVER_WEIGHTS:
        if is_sparse(samples):
            raise ValueError("weights in blocks of features take dense samples")
        frame, course, eig = _in_blocks(prepared(samples, p), p, d, v, lw, start, feature_block or FEATURE_BLOCK, n)
        low, high = frame.agg(F.min("score"), F.max("score")).first()
        facts |= {"score_minmax": (low, high), "weights": frame}
        frame = frame.select("fid", "score")
    else:
        w, course, eig = _on_driver(prepared(samples, p), p, d, v, lw, start)
        scores = np.linalg.norm(w, axis=1)
        frame = samples.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(scores)], "fid int, score double")
        facts |= {"score_minmax": (float(scores.min()), float(scores.max())), "scores": scores, "weights": w}
    facts |= {"objective_start": course.losses[0], "objective_end": course.losses[-1], "objectives": course.losses, "iterations": course.steps, "bias": course.bias}
    facts |= {"xtx_eig": eig, "step_w": course.problem.step_w, "step_b": course.problem.step_b}
    return ranking(frame), facts


def _on_driver(samples: DataFrame, p: EmbeddedParams, d: int, v: np.ndarray, lw: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, Course, float]:
    """The weights, what was done, and the greatest eigenvalue, with weights on the driver. Rows are kept as binary blocks, so that a pass reads few of them."""
    r, n_labels = v.shape[1], len(lw)
    rows = row_blocks(samples).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = n_partitions(rows)
        small = d <= GRAM_FEATURES
        g = gram(rows, d, parts) if small else None
        s_sum = float(block_sums(rows, lambda x, y, s: np.array([s.sum()]), parts)[0])
        eig = greatest_eigenvalue(g, p.power_iter, p.seed) if small else matrix_free_eigenvalue(rows, d, p.power_iter, p.seed, parts)
        course = Course(Problem(p, v, lw, s_sum, *step_sizes(p, eig, s_sum)))
        w = 0.01 * np.random.default_rng(p.seed).standard_normal((d, r)) if start is None else start.copy()
        z = w.copy()
        from_gram = small and p.alpha == 0  # all sums follow from the Gram matrix
        if from_gram:
            c = block_sums(rows, lambda x, y, s: (x.T @ (s[:, None] * (((y > 0) * lw) @ v))).ravel(), parts).reshape(d, r)
            squares = float(block_sums(rows, lambda x, y, s: np.array([(s[:, None] * (((y > 0) * lw) @ v) ** 2).sum()]), parts)[0])

        def sums() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if from_gram:
                return g @ z - c, np.zeros(n_labels), np.array([np.sum(w * (g @ w)) - 2 * np.sum(w * c) + squares, 0.0])
            out = block_sums(rows, gradient_sums(course.problem, z, course.z_bias, w, course.bias), parts)
            return out[: d * r].reshape(d, r), out[d * r : d * r + n_labels], out[-2:]

        gradient, e_sum, _ = sums()
        for _ in range(p.max_iter):
            new = shrink_rows(z - course.problem.step_w * (gradient + 2 * p.rho * z), course.problem.step_w * p.beta, np.finfo(float).eps)
            z = new + course.ahead(e_sum) * (new - w)
            w = new
            if course.at_end:
                break
            gradient, e_sum, loss = sums()  # one pass gives the loss here and the gradient of the next step
            if course.judged and course.settled(objective(course.problem, w, loss)):
                break
    finally:
        rows.unpersist()
    return w, course, eig
