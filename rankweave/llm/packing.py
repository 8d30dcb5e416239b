"""Packing of documents into training windows by multiway Karmarkar-Karp differencing.

Every partition of the input is packed by itself, as a stream. Documents of a window or more give up whole windows first; what remains is
cut into pieces of at most ``PIECE`` tokens (neighbours of an eighth of that together count as one) and gathered into blocks of ``WINDOWS`` windows, less a small reserve for each window. In a block,
partial partitions whose imbalances oppose each other are merged, largest difference first, until one partition into near-equal windows is
left; if a window then exceeds its capacity, the count of windows rises by one and the block is partitioned again. At the end of a partition,
what is too little for a window goes into sequences whose lengths are powers of two, which need no padding.

Null texts count as empty; a document always has its end id, so each has a piece at least; repeated rows are packed as often as they come;
an empty table gives no pieces; further columns are left out. Nothing is shuffled, and a task holds one block and one document at a time.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.shared import idle, in_small_batches, table
from rankweave.llm.units import library_memo

WINDOW = 4096
PIECE = 512
WINDOWS = 32
RESERVE = 16
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Partition the items into ``k`` sets of near-equal sums; gives the items' places by set."""
    heap = [(-n, i, [n] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        merged = sorted(zip([a + b for a, b in zip(sums_a, reversed(sums_b), strict=True)], range(k), strict=True), reverse=True)
        sets = [x + y for x, y in zip(sets_a, reversed(sets_b), strict=True)]
        least = merged[-1][0]
        heapq.heappush(heap, (least - merged[0][0], tick, [s - least for s, _ in merged], [sets[j] for _, j in merged]))
        tick += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def windows_of(sizes: Sequence[int], capacity: int, k: int) -> list[list[int]]:
    """Near-equal windows, ``k`` or as many more as the capacity asks for."""
    while True:
        sets = difference(sizes, k)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return [s for s in sets if s]
        k += 1


def bundles(pieces: list[tuple], most: int) -> list[list[tuple]]:
    """Neighbouring pieces together as long as they have ``most`` tokens at most, so that a block of tiny documents has few items to partition."""
    out, room = [], 0
    for p in pieces:
        if out and p[2] <= room:
            out[-1].append(p)
            room -= p[2]
        else:
            out.append([p])
            room = most - p[2]
    return out


def pack(docs: Iterable[tuple], capacity: int = WINDOW, piece: int = PIECE, windows: int = WINDOWS, reserve: int = RESERVE) -> Iterator[list[tuple]]:
    """From (key, number of tokens) to sequences of (key, start, length, tokens), in a stream."""
    full = (capacity - reserve) * windows
    block: list[tuple] = []
    held = 0

    def flush(k: int) -> Iterator[list[tuple]]:
        held_together = bundles(block, piece // 8)
        for s in windows_of([sum(p[2] for p in b) for b in held_together], capacity, k):
            yield [p for i in s for p in held_together[i]]

    for key, n in docs:
        start = 0
        while n - start >= capacity:
            yield [(key, start, capacity, n)]
            start += capacity
        while start < n:
            size = min(piece, n - start, full - held)
            block.append((key, start, size, n))
            start, held = start + size, held + size
            if held == full:
                yield from flush(windows)
                block, held = [], 0
    if (k := held // (capacity - reserve)) > 0:
        rest, last = [], k * (capacity - reserve)
        while held > last:  # what is over comes from the end
            key, start, size, n = block.pop()
            cut = min(size, held - last)
            rest.append((key, start + size - cut, cut, n))
            if cut < size:
                block.append((key, start, size - cut, n))
            held -= cut
        yield from flush(k)
        block = rest[::-1]
    yield from powers_of_two(block)


def powers_of_two(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Sequences whose lengths are the powers of two that add up to the whole."""
    left = sum(p[2] for p in pieces)
    waiting = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            key, start, size, n = waiting.pop()
            cut = min(size, room)
            out.append((key, start, cut, n))
            if cut < size:
                waiting.append((key, start + cut, size - cut, n))
            room -= cut
        yield out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) and their places in sequences."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PIECES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, sequence = library_memo(tokenizer, joined=False), TaskContext.get().partitionId() << 32

        def encoded() -> Iterator[tuple]:
            for batch in in_small_batches(batches, 1):
                for doc_id, ids in zip(batch.column(0).to_pylist(), memo.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    yield (doc_id, ids.tobytes() + end), len(ids) + 1

        rows: list[tuple] = []
        for s in pack(encoded()):
            offset = 0
            for (doc_id, ids), start, length, n in s:
                rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n, sequence, offset))
                offset += length
            sequence += 1
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        memo.rest()
        idle()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
