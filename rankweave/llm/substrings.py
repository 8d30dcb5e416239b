"""Substring deduplication: seed and extend.

Seeds are winnowed anchors: of every window of 50 consecutive words, the least hash among its 12-word grams. Documents are joined on anchors, each
with the smallest doc_id that holds it. The windows that share an anchor are consecutive, so an anchor extends to both sides as a run of windows, and
equal runs are one match; where one anchor stands in runs that differ (matches end somewhere between), one copy of each run is extended window by
window. Matches that overlap or touch are merged into maximal repeats, (document, start, length) of at least 50 words, and these decide what goes:
a word is removed if it is covered by a window that also starts in a document with a smaller doc_id.

Rows that repeat are aggregated before they are shuffled; anchors, runs and windows that hold over one in ``HOT_SHARE`` of the rows are looked up by
broadcast (there are fewer than ``HOT_SHARE`` of them), so that none of them meets in one task; and no pairs of documents arise.

Words are runs of characters other than ASCII white space, unchanged. Null texts have no words; texts of fewer than 50 words lose nothing; rows
with a null doc_id lose nothing and take nothing from others; rows that repeat a doc_id are each judged by their own text, and never lose words
to each other; further columns are left out of digests and kept by ``without_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankweave.llm.shared import HOT_SHARE, fresh, idle, in_small_batches, looked_up, table, written

WINDOW = 50
GRAM = 12
WORDS_KEPT = 150_000
TEXT_BATCH = 4 << 20
RUNS = "anchor long, run long, doc_id long, tag long, place long"
WINDOWS = "window long, doc_id long, tag long, place long"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from hashes of runs half as long."""
    out, size, power, length = None, 0, words, 1
    while True:
        if n & length:
            k = len(words) - size - length + 1
            if k <= 0:
                return np.zeros(0, np.uint64)
            out = power[:k] if out is None else _join(out[:k], power[size : size + k])
            size += length
        length *= 2
        if length > n:
            return out
        k = len(words) - length + 1
        if k <= 0:
            return np.zeros(0, np.uint64)
        power = _join(power[:k], power[length // 2 : length // 2 + k])


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    length = 1
    while 2 * length <= n:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    return np.minimum(h[: len(h) - (n - length)], h[n - length :]) if n > length else h


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and the texts' bounds in them."""
    if len(_HASHES) > WORDS_KEPT:
        _HASHES.clear()
    parts, bounds = [], [0]
    for t in texts:
        words = t.encode("utf-8").split() if t else []
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        bounds.append(bounds[-1] + len(words))
    return np.concatenate(parts), np.array(bounds)


def _packed(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows in a long."""
    return first.astype(np.int64) << 8 | count.astype(np.int64)


def runs_of(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, first window, number of windows, anchor and content hash of each run of windows with one anchor."""
    words, bounds = word_hashes(texts)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchors, windows = sliding_min(gram_hashes(words, GRAM), WINDOW - GRAM + 1), gram_hashes(words, WINDOW)
    text = np.searchsorted(bounds, np.arange(n), "right") - 1
    valid = np.arange(n) + WINDOW <= bounds[text + 1]
    starts = np.flatnonzero(valid & np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])]))
    ends = np.flatnonzero(valid & np.concatenate([(anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | ~valid[1:], [True]])) + 1
    long = np.flatnonzero(ends - starts > WINDOW)  # only where words repeat; their runs are cut, so that both ends cover a run
    if len(long):
        more = [np.arange(s, e, WINDOW) for s, e in zip(starts[long], ends[long], strict=True)]
        starts = np.concatenate([np.delete(starts, long), *more])
        ends = np.concatenate([np.delete(ends, long), *[np.append(m[1:], e) for m, e in zip(more, ends[long], strict=True)]])
    content = _join(_join(windows[starts], windows[ends - 1]), (ends - starts).astype(np.uint64))
    return text[starts], starts - bounds[text[starts]], ends - starts, anchors[starts], content


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) of the rows with an id; the tag tells apart texts that share one."""
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def all_runs(docs: DataFrame) -> DataFrame:
    """(anchor, run, doc_id, tag, place): every run of every document; ``place`` packs first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 2, TEXT_BATCH):
            ids, tags = (batch.column(k).to_numpy() for k in (0, 1))
            text, first, count, anchor, content = runs_of(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor.view(np.int64), content.view(np.int64), ids[text], tags[text], _packed(first, count))], ["anchor", "run", "doc_id", "tag", "place"])
        _HASHES.clear()  # an idle worker is small
        idle()

    return tagged(docs).mapInArrow(run, RUNS)


def windows_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(window, doc_id, tag, place): the windows of the runs in ``places`` (doc_id, tag, places), one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 2, TEXT_BATCH):
            ids, tags = (batch.column(k).to_numpy() for k in (0, 1))
            words, bounds = word_hashes(batch.column(2).to_pylist())
            windows = gram_hashes(words, WINDOW)
            out: list[np.ndarray] = []
            for k, own in enumerate(batch.column(3)):
                packed = own.values.to_numpy()
                first, count = packed >> 8, packed & 0xFF
                at = np.unique(np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
                out.append(np.stack([windows[at + bounds[k]].view(np.int64), np.full(len(at), ids[k]), np.full(len(at), tags[k]), _packed(at, np.ones(len(at)))]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["window", "doc_id", "tag", "place"])
        _HASHES.clear()
        idle()

    return tagged(docs).join(places, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places").mapInArrow(run, WINDOWS)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, place): the runs and windows of each document that also start in a document with a smaller id."""
    runs = written(all_runs(docs), "runs")
    least = max(1, runs.count() // HOT_SHARE)
    seeds = written(runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n"), "seeds")
    seeded = written(looked_up(runs, seeds, ["anchor"], least).drop("n"), "seeded")
    # equal runs: one match each; where an anchor's runs differ, they stay open
    first = seeded.groupBy("anchor", "run").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    mixed = written(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    marked = looked_up(first, mixed.withColumnRenamed("n", "runs"), ["anchor"], least, "runs", how="left").withColumn("mixed", F.col("runs").isNotNull()).drop("runs")
    judged = written(looked_up(seeded, written(marked, "first-runs"), ["anchor", "run"], least).select("doc_id", "tag", "place", (F.col("first_id") < F.col("doc_id")).alias("repeated"), "mixed"), "judged")
    whole = judged.where("repeated").select("doc_id", "tag", "place")
    # one copy of each open run, window by window
    open_runs = judged.where("mixed and not repeated").groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places"))  # at most the runs of one text
    windows = written(windows_at(docs, open_runs), "windows")
    shared = windows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high")
    return whole.union(looked_up(windows, written(shared, "shared-windows"), ["window"], least).where("low < doc_id").select("doc_id", "tag", "place"))


def merged(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of words that the runs and windows cover."""
    first = np.sort(places) >> 8
    ends = np.maximum.accumulate(first + (np.sort(places) & 0xFF) + WINDOW - 1)
    begins = np.concatenate([[True], first[1:] > ends[:-1]])
    starts = first[begins]
    return starts, ends[np.append(np.flatnonzero(begins)[1:] - 1, len(ends) - 1)] - starts


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, starts, lengths): the maximal repeats of each text, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(own.values.to_numpy()) for own in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in spans], pa.list_(pa.int64())), pa.array([n for _, n in spans], pa.list_(pa.int64()))], ["doc_id", "tag", "starts", "lengths"])

    grouped = matches(docs).groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places"))
    return grouped.mapInArrow(run, "doc_id long, tag long, starts array<long>, lengths array<long>")


def keep(text: str | None, starts: np.ndarray | None, lengths: np.ndarray | None) -> tuple[list[bytes], int]:
    """The words outside the repeats, and how many words there were."""
    words = text.encode("utf-8").split() if text else []
    if starts is None or not words:
        return words, len(words)
    kept, at = [], 0
    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        kept += words[at:start]
        at = start + length
    return kept + words[at:], len(words)


def _array(x: pa.Scalar) -> np.ndarray | None:
    return x.values.to_numpy() if x.is_valid else None


def digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 1, TEXT_BATCH):
            rows = []
            for text, starts, lengths in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                kept, n = keep(text, _array(starts), _array(lengths))
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n_words, n_removed, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return rows.join(maximal_repeats(docs), ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "lengths").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@F.arrow_udf(StringType())
def _cut_text(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    def one(text: str | None, *spans: pa.Scalar) -> str | None:
        kept, n = keep(text, *map(_array, spans))
        return text if len(kept) == n else b" ".join(kept).decode("utf-8")

    return pa.array([one(t.as_py(), s, n) for t, s, n in zip(texts, starts, lengths, strict=True)], pa.string())


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of their texts (words that stay are joined by one space; texts without repeats are unchanged) and
    n_chars, where it is a column, counted anew. Rows of which nothing is left go."""
    key, tag, starts, lengths, new = (fresh(name, docs) for name in ("repeat_doc_id", "repeat_tag", "repeat_starts", "repeat_lengths", "repeat_text"))
    found = maximal_repeats(docs).toDF(key, tag, starts, lengths)
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(tag))
    # the function counts as not deterministic, else it would run once for the filter and once for the column
    cut = F.when(F.col(key).isNull(), F.col("text")).otherwise(_cut_text.asNondeterministic()(F.col("text"), F.col(starts), F.col(lengths)))
    stays = docs.join(found, same, "left").withColumn(new, cut).where(F.col("text").isNull() | (F.col("text") == F.col(new)) | (F.col(new) != ""))
    n_chars = F.coalesce(F.length(new), F.lit(0)).cast("long")
    return stays.select(*[F.col(new).alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove from all documents the words of repeats of 50 words and more."""
    return digests(table(spark, sf_dir, "documents"))
