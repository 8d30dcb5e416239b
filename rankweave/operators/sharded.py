"""The embedded solver with weights in blocks of features: neither a task nor the driver holds a features-by-targets matrix.

Samples become tiles (rb, fb, x): a block of rows by a block of features. They are kept twice, dealt by row block and dealt by feature block (few feature blocks
in parts, each of which meets the weights of its block), so that neither product of a step moves them: X W joins the tiles with the blocks of W by feature block, X' E joins them with the blocks of E by row block, and only partial sums
are shuffled. A step is then: products of all row blocks with the weights, what each row block contributes (residuals, sums, losses), the gradient of each feature
block, and the proximal step of each feature block by itself, as the penalty is a sum over features. The driver keeps sums over all rows and what is as long as a row of labels.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Doubles of a block, and of the sums that a task holds before it hands them on.
ELEMENTS = 1 << 20
HELD = 1 << 23


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the folder of ``spark.checkpoint.dir``; how its rows are dealt stays known."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def row_blocks(rows: DataFrame, least: int = 1) -> DataFrame:
    """(n, x, y, s): blocks of the rows (features, labels, s) as binary matrices of doubles, bytes and doubles, of about ``ELEMENTS`` features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        room = 0

        def block() -> pa.RecordBatch:
            x, y, s = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, s))], ["n", "x", "y", "s"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) > 0
            s = batch.column(2).to_numpy(zero_copy_only=False)
            most = max(least, ELEMENTS // max(1, x.shape[1]))
            for at in range(0, n, most):
                some = slice(at, at + most)
                held.append((x[some], y[some].astype(np.int8), s[some]))
                room += len(s[some])
                if room >= most:
                    yield block()
                    room = 0
        if held:
            yield block()

    return rows.select("features", "labels", "s").mapInArrow(run, "n int, x binary, y binary, s binary")


def matrix(raw: pa.Scalar, columns: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind).reshape(-1, columns)


def summed(parts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, v): the sums of binary arrays of doubles (key, v) of equal key, as a stream sorted by key; ``n``: partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], [key, "v"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(raw.as_buffer())
                if k != at:
                    yield from done()
                    at, total = k, v.copy()
                else:
                    total += v
        yield from done()

    return parts.select(key, "v").repartition(n, key).sortWithinPartitions(key).mapInArrow(run, f"{key} long, v binary")


@dataclass
class Tiles:
    """``by_rows`` and ``by_features``: (rb, fb, n, x), dealt by row block and by feature block and ``part`` of its tiles (of ``parts_of_block``); ``rows``: (rb, n, y, s).
    ``parts``: partitions by rb and by fb, no more than there are blocks."""

    by_rows: DataFrame
    by_features: DataFrame
    rows: DataFrame
    d: int
    n_labels: int
    block: int
    parts: dict[str, int]
    parts_of_block: int

    def _products(self, met: DataFrame, key: str, work: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: Callable[[int], int], wide: int) -> DataFrame:
        """(key, v): ``work`` on pairs of a tile and a block of ``wide`` columns, added up by key."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], [key, "v"])
                sums.clear()
                return made

            for batch in batches:
                for k, fb, x, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    got = work(matrix(x, columns(fb)), matrix(v, wide)).ravel()
                    sums[k] = sums[k] + got if k in sums else got
                    if len(sums) * len(got) > HELD:
                        yield out()
            if sums:
                yield out()

        return summed(met.mapInArrow(run, f"{key} long, v binary"), key, self.parts[key])

    def columns(self) -> Callable[[int], int]:
        d, block = self.d, self.block
        return lambda fb: min(block, d - fb * block)

    def times(self, w: DataFrame, wide: int) -> DataFrame:
        """(rb, v): X W of each row block, for blocks (fb, w) of ``wide`` columns."""
        of_parts = w.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts_of_block - 1))))
        met = self.by_features.join(of_parts, ["fb", "part"]).select("rb", "fb", "x", "w")
        return self._products(met, "rb", lambda x, w: x @ w, self.columns(), wide)

    def transposed_times(self, e: DataFrame, wide: int) -> DataFrame:
        """(fb, v): X' E of each feature block, for blocks (rb, e) of ``wide`` columns."""
        met = self.by_rows.join(e, "rb").select("fb", F.col("fb").alias("of"), "x", "e")
        return self._products(met, "fb", lambda x, e: x.T @ e, self.columns(), wide)


def tiled(rows: DataFrame, d: int, n_labels: int, block: int, n: int | None = None) -> Tiles:
    """Tiles of the rows (features, labels, s) with ``block`` features each. Where their number ``n`` is known, rows of many small partitions go into full blocks together."""
    spark = rows.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n is not None:
        rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-n * d // ELEMENTS)))
    blocks = checkpointed(row_blocks(rows).withColumn("rb", F.monotonically_increasing_id()))
    n_rb, n_fb = blocks.count(), -(-d // block)
    parts, all_parts = {"rb": max(1, min(most, n_rb)), "fb": min(most, n_fb)}, max(1, min(most, n_rb * n_fb))
    parts_of_block = -(-all_parts // n_fb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = matrix(raw, d)
                for fb in range(-(-d // block)):
                    yield pa.RecordBatch.from_arrays([pa.array([rb], pa.int64()), pa.array([fb], pa.int64()), pa.array([n], pa.int32()), pa.array([x[:, fb * block : (fb + 1) * block].tobytes()], pa.binary())], ["rb", "fb", "n", "x"])

    tiles = blocks.select("rb", "n", "x").mapInArrow(run, "rb long, fb long, n int, x binary")
    by_features = tiles.withColumn("part", F.pmod(F.xxhash64("rb"), F.lit(parts_of_block)).cast("int")).repartition(all_parts, "fb", "part")
    by_rows, labels = tiles.repartition(parts["rb"], "rb"), blocks.select("rb", "n", "y", "s").repartition(parts["rb"], "rb")
    return Tiles(checkpointed(by_rows), checkpointed(by_features), checkpointed(labels), d, n_labels, block, parts, parts_of_block)


def blocks_of(spark: SparkSession, tiles: Tiles, make: Callable[[int, int], np.ndarray]) -> DataFrame:
    """(fb, w): a matrix of all features by blocks; ``make`` gets a block's first feature and its number of features."""
    d, block = tiles.d, tiles.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fb in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([fb], pa.int64()), pa.array([np.ascontiguousarray(make(fb * block, min(block, d - fb * block)), float).tobytes()], pa.binary())], ["fb", "w"])

    return spark.range(0, -(-d // block), 1, tiles.parts["fb"]).select(F.col("id").alias("fb")).mapInArrow(run, "fb long, w binary")


def mapped(df: DataFrame, work: Callable[..., dict], schema: str) -> DataFrame:
    """``work`` gets the values of each row by position (binary ones as buffers) and returns a row."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = work(*(c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array([got[c]], t) for c, t in zip(names, types, strict=True)], names)

    return df.mapInArrow(run, schema)


def greatest_eigenvalue(tiles: Tiles, n_iter: int, start: DataFrame) -> float:
    """Of X' S X by power iteration from the blocks ``start`` (fb, w); 0 where it gives a vector of no length."""
    v, scale = start, None

    def squares(df: DataFrame, column: str = "w") -> float:
        return float(mapped(df.select(column), lambda raw: {"q": float((np.frombuffer(raw) ** 2).sum())}, "q double").agg(F.sum("q")).first()[0] or 0.0)

    size = np.sqrt(squares(v)) + 1e-12
    for last in [False] * n_iter + [True]:
        scale = 1 / size
        xv = tiles.times(v, 1).join(tiles.rows.select("rb", "s"), "rb").select("rb", "v", "s")
        sxv = mapped(xv, lambda rb, raw, s, scale=scale: {"rb": rb, "e": (np.frombuffer(raw) * np.frombuffer(s) * scale).tobytes()}, "rb long, e binary")
        if last:  # v' X' S X v from the rows alone
            return float(mapped(xv, lambda rb, raw, s, scale=scale: {"q": float((np.frombuffer(s) * (np.frombuffer(raw) * scale) ** 2).sum())}, "q double").agg(F.sum("q")).first()[0])
        v = checkpointed(tiles.transposed_times(sxv, 1).withColumnRenamed("v", "w"))
        size = np.sqrt(squares(v))
        if size <= 1e-12:
            return 0.0
    return 0.0


@dataclass
class Steps:
    """Accelerated proximal gradients on ``tiles``; ``problem`` is that of the solver. ``state``: (fb, w, z, lengths, squares)."""

    tiles: Tiles
    problem: object
    state: DataFrame

    @classmethod
    def at(cls, tiles: Tiles, problem: object, start: DataFrame) -> Steps:
        state = mapped(start, lambda fb, w: {"fb": fb, "w": w.to_pybytes(), "z": w.to_pybytes(), "lengths": 0.0, "squares": 0.0}, "fb long, w binary, z binary, lengths double, squares double")
        return cls(tiles, problem, checkpointed(state))

    def sums(self, z_bias: np.ndarray, bias: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """The gradient (fb, v) of both parts at (z, z_bias), the sums of the bias' gradient there, and both losses at (w, bias)."""
        p, v, lw = self.problem.p, self.problem.v, self.problem.label_weights
        r, n_labels = v.shape[1], len(lw)

        def both(fb: int, w: pa.Buffer, z: pa.Buffer) -> dict:
            return {"fb": fb, "w": np.concatenate([np.frombuffer(z).reshape(-1, r), np.frombuffer(w).reshape(-1, r)], axis=1).tobytes()}

        def rows(rb: int, xzw: pa.Buffer, y: pa.Buffer, s: pa.Buffer) -> dict:
            xzw, y, s = np.frombuffer(xzw).reshape(-1, 2 * r), np.frombuffer(y, np.int8).reshape(-1, n_labels).astype(float), np.frombuffer(s)
            xz, xw, t = xzw[:, :r], xzw[:, r:], (y * lw) @ v
            e = (1 - p.alpha) * s[:, None] * (xz - t)
            e_sum, loss = np.zeros(n_labels), np.array([(s[:, None] * (xw - t) ** 2).sum(), 0.0])
            if p.alpha > 0:
                logits = xz @ v.T + z_bias
                off = s[:, None] * (0.5 * (1 + np.tanh(logits / 2)) - y)
                e = e + p.alpha * (off @ v)
                e_sum = off.sum(axis=0)
                at_w = xw @ v.T + bias
                loss[1] = (s[:, None] * (np.maximum(at_w, 0) + np.log1p(np.exp(-np.abs(at_w))) - y * at_w)).sum()
            return {"rb": rb, "e": e.tobytes(), "more": np.concatenate([e_sum, loss]).tobytes()}

        weights = mapped(self.state.select("fb", "w", "z"), both, "fb long, w binary")
        met = self.tiles.times(weights, 2 * r).join(self.tiles.rows.select("rb", "y", "s"), "rb").select("rb", "v", "y", "s")
        of = checkpointed(mapped(met, rows, "rb long, e binary, more binary"))
        # sums over all rows meet in fewer tasks first
        more = summed(of.select((F.abs(F.xxhash64("rb")) % 16).alias("part"), F.col("more").alias("v")), "part", min(16, self.tiles.parts["rb"])).collect()
        total = np.sum([np.frombuffer(x["v"]) for x in more], axis=0)
        return self.tiles.transposed_times(of.select("rb", "e"), r), total[:n_labels], total[n_labels:]

    def step(self, gradient: DataFrame, ahead: float) -> None:
        """The proximal step of each feature block, and the point ``ahead`` of it."""
        from rankweave.operators.solver import shrink_rows

        p, step_w, r = self.problem.p, self.problem.step_w, self.problem.v.shape[1]

        def block(fb: int, w: pa.Buffer, z: pa.Buffer, g: pa.Buffer) -> dict:
            w, z, g = (np.frombuffer(x).reshape(-1, r) for x in (w, z, g))
            new = shrink_rows(z - step_w * (g + 2 * p.rho * z), step_w * p.beta, np.finfo(float).eps)
            return {"fb": fb, "w": new.tobytes(), "z": (new + ahead * (new - w)).tobytes(), "lengths": float(np.linalg.norm(new, axis=1).sum()), "squares": float((new * new).sum())}

        met = self.state.join(gradient, "fb").select("fb", "w", "z", "v")
        self.state = checkpointed(mapped(met, block, "fb long, w binary, z binary, lengths double, squares double"))

    def penalties(self) -> tuple[float, float]:
        got = self.state.agg(F.sum("lengths"), F.sum("squares")).first()
        return float(got[0] or 0.0), float(got[1] or 0.0)

    def weights(self) -> DataFrame:
        """(fid, w, score) of every feature."""
        r, block = self.problem.v.shape[1], self.tiles.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fb, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    w = matrix(raw, r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32) + fb * block), pa.array(list(w), pa.list_(pa.float64())), pa.array(np.linalg.norm(w, axis=1))], ["fid", "w", "score"])

        return self.state.select("fb", "w").mapInArrow(run, "fid int, w array<double>, score double")
