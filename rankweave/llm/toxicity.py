"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram of 3 to 5 bytes of the lower-cased text between spaces; its value in a text is its share of the text's n-grams,
in hundredths, times its log-count ratio ``log((toxic rows with it + a) / all) - log((other rows with it + a) / all)``. The classifier is a
logistic regression on these values.

Learning uses at most about ``TRAIN_ROWS`` labelled rows (a documented bound: rows are chosen by a hash of their id, evenly from all labelled
ones) and never rows that are held out. Counts of n-grams are Spark aggregations; the driver gets the ``FEATURES`` most telling n-grams and the
sparse rows of the bounded sample. Scoring covers every whole text.

Null and empty texts have the score of a text without n-grams; a null doc_id counts as an empty id; rows without a label, or with a null one,
teach nothing; without labelled rows of both classes every score is 0. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.shared import fresh, in_small_batches, table, written

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 4096
TRAIN_ROWS = 20_000
SMOOTHING = 1.0
RIDGE = 1e-5
STEP = 0.1
STEPS = 400
THRESHOLD = 0.3
SLICE = 1 << 20
ROWS_AT_ONCE = 500
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _prepared(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(SPACES) + b" " if text else b""


def _hashed(raw: np.ndarray) -> list[np.ndarray]:
    """Of each order, the bucket of the n-gram at each place."""
    out, h = [], raw.astype(np.uint32)
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            h = h[:0]
        else:
            h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :][: len(h) - 1]
        if n in ORDERS:
            out.append(((h ^ h >> np.uint32(15)) * np.uint32(0x9E3779B1 + 2 * n) >> np.uint32(12)).astype(np.int32))
    return out


@dataclass(frozen=True)
class Model:
    """``buckets`` and their weights (log-count ratio times coefficient, for shares in hundredths); bias None: nothing was learnt."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float | None

    def dense(self) -> np.ndarray:
        w = np.zeros(BUCKETS, np.float32)
        w[self.buckets] = self.weights
        return w

    def score(self, texts: list[str | None], dense: np.ndarray) -> np.ndarray:
        """Of each text, the probability of being toxic. Texts are joined and taken in slices, so that memory is bounded."""
        if self.bias is None:
            return np.zeros(len(texts))
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        group: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if not group:
                return
            raw = np.frombuffer(b"".join(b for _, b in group), np.uint8)
            rows, ends = np.array([i for i, _ in group]), np.cumsum([len(b) for _, b in group])
            starts = np.concatenate([[0], ends[:-1]])
            for n, places in zip(ORDERS, _hashed(raw), strict=True):
                sums = np.concatenate([[0.0], np.cumsum(dense[places], dtype=np.float64)])
                last = np.maximum(ends - n + 1, starts)
                np.add.at(total, rows, sums[np.minimum(last, len(sums) - 1)] - sums[np.minimum(starts, len(sums) - 1)])
                np.add.at(count, rows, last - starts)

        for i, text in enumerate(texts):
            raw, reach = _prepared(text), max(ORDERS) - 1
            if len(raw) > SLICE:  # slices overlap; n-grams in the overlap are taken away again by the shorter orders' own ends
                t, c = self._long(raw, dense)
                total[i], count[i] = t, c
                continue
            if size + len(raw) > SLICE:
                flush()
                group, size = [], 0
            group.append((i, raw))
            size += len(raw) + reach
        flush()
        return 1 / (1 + np.exp(-np.clip(self.bias + 100 * total / np.maximum(count, 1), -500, 500)))

    def _long(self, raw: bytes, dense: np.ndarray) -> tuple[float, float]:
        total = count = 0.0
        reach = max(ORDERS) - 1
        for at in range(0, len(raw), SLICE):
            piece = np.frombuffer(raw[at : at + SLICE + reach], np.uint8)
            for n, places in zip(ORDERS, _hashed(piece), strict=True):
                own = places[: min(SLICE, len(raw) - n + 1 - at)]
                total += float(dense[own].sum(dtype=np.float64))
                count += len(own)
        return total, count


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(label, text) of about ``most`` labelled rows that aren't held out, or of all if they are fewer; chosen by a hash of the id."""
    taught = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
    share = min(1.0, most / max(1, taught.count()))
    chosen = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where(chosen).join(taught.where(chosen), "doc_id").select("label", "text")


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, others, toxic): in how many rows of each class the n-gram occurs; summed within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int32)
        for batch in in_small_batches(batches, 1):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(_prepared(text), np.uint8)
                sums[label, np.unique(np.concatenate(_hashed(raw)))] += 1
        at = np.flatnonzero(sums.any(axis=0))
        for k in range(0, len(at), 50_000):
            some = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[0, some], pa.int64()), pa.array(sums[1, some], pa.int64())], ["bucket", "others", "toxic"])

    return rows.mapInArrow(count, "bucket int, others long, toxic long").groupBy("bucket").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = written(training_rows(docs, labels), "toxicity-rows")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), None)
    if len(sizes) < 2:
        return nothing
    p = (F.col("toxic") + SMOOTHING) / (sizes[1] + 2 * SMOOTHING)
    q = (F.col("others") + SMOOTHING) / (sizes[0] + 2 * SMOOTHING)
    ratio = F.log(p) - F.log(q)
    best = ngram_counts(rows).select("bucket", ratio.alias("ratio"), ((p - q) * ratio).alias("telling")).orderBy(F.desc("telling"), "bucket").limit(FEATURES).collect()
    if not best:
        return nothing
    best.sort()
    buckets, ratios = np.array([r["bucket"] for r in best]), np.array([r["ratio"] for r in best])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in in_small_batches(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                every = np.concatenate(_hashed(np.frombuffer(_prepared(text), np.uint8)))
                at, n = np.unique(place[every], return_counts=True)
                keep = at >= 0
                out.append((at[keep], (100 * n[keep] / max(1, len(every))).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float32()))], ["label", "at", "share"])

    sample = rows.mapInArrow(features, "label int, at array<int>, share array<float>").toArrow()
    y = sample.column("label").to_numpy().astype(float)
    lengths = np.array([len(x) for x in sample.column("at")])
    row = np.repeat(np.arange(len(y)), lengths)
    at = sample.column("at").combine_chunks().flatten().to_numpy()
    x = sample.column("share").combine_chunks().flatten().to_numpy().astype(float) * ratios[at]
    coefficients, bias = logistic(row, at, x, y, len(buckets))
    return Model(buckets, (coefficients * ratios).astype(np.float32), bias)


def logistic(row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of sparse rows by full gradients with adaptive steps (one step size for each feature)."""
    n = len(y)
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    for k in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], n) + w[-1], -500, 500)))
        e = (p - y) / n
        g = np.append(np.bincount(at, x * e[row], n_features) + RIDGE * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= STEP * (1 - k / (STEPS + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w[:-1], float(w[-1])


def scorer(model: Model):
    """A function of a text column: its score."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = model.dense()
        for part in parts:
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(part[k : k + ROWS_AT_ONCE].to_pylist(), dense) for k in range(0, len(part), ROWS_AT_ONCE))]))

    return lambda text: score(text.cast("string"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    score = fresh("toxicity_score", docs)
    return docs.withColumn(score, scorer(model)(F.col("text"))).where(F.col(score) < THRESHOLD).drop(score)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels that aren't held out and score all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
