"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 16 segments of 4 bits; the counts of set bits by segment are a point of a grid. Two fingerprints that differ in at
most 2 bits have points at a Manhattan distance of at most 2 (the distance is a lower bound), so there is a grid cell within 1 of both: each
fingerprint goes to its own cell and to the cells next to it, and fingerprints that meet in a cell are compared exactly. Work is done on
distinct fingerprints, so copies cost one row.

A cell with more than ``CELL`` fingerprints is split by the same method at a finer grid: its members go to the counts of 2-bit segments, and what
is still too full there to the counts of 1-bit segments, where the Manhattan distance is the Hamming distance itself. In this last grid fingerprints
that share a cell are within 2 bits of each other and a cell has 65 of them at most, so each is linked to the least of its cell. Nothing is dropped
or capped: two fingerprints that meet in a full cell meet again in each finer grid.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles have 3 words, repeats count, fewer words are one shingle, and
a text without words (null, empty) has fingerprint zero and is linked like any other. Rows with a null doc_id take part, but are never the
smallest id of a component. Repeated rows stay; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.components import components
from rankweave.llm.shared import HOT_SHARE, fresh, looked_up, map_batches, passing, table, written

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENT = 4
FINER = (4, 2, 1)
CELL = 48
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        some = words[at : min(at + SHINGLES_AT_ONCE, n) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        ones += bits_set(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints of sets of shingles given as hashes, so many for each set, as signed longs. Eight bits of a hash are counted in one sum, 255 hashes at a time."""
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    ones = np.zeros((len(sizes), 8, 8), np.int64)  # bit, byte
    for k in range(8 if len(hashes) else 0):
        counts = np.add.reduceat(hashes >> np.uint64(k) & np.uint64(0x0101010101010101), starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones[sizes > 0, k] = np.add.reduceat(counts, first[sizes > 0], dtype=np.int64)
    return np.packbits(2 * ones.transpose(0, 2, 1).reshape(-1, 64) > sizes[:, None], axis=1, bitorder="little").view("<i8")[:, 0].astype(np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles given as hashes, as a signed long."""
    return int(fingerprints_of(hashes, np.array([len(hashes)]))[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every row as a signed long, and a hash of its text."""

    def work(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": prints.view(np.int64), "text_hash": batch.column(2)}

    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), work, "doc_id long, fp long, text_hash long", "text")


def segment_counts(fp: Column, bits: int = SEGMENT) -> Column:
    """The counts of set bits in each segment of 4, 2 or 1 bits, as fields of that many bits of a long (bit operations only, so nothing overflows)."""
    if bits == 1:
        return fp
    pairs, fours = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    shifted = F.shiftrightunsigned(fp, 1)
    two = fp.bitwiseXOR(shifted).bitwiseAND(pairs).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(pairs), 1))
    return two if bits == 2 else two.bitwiseAND(fours) + F.shiftrightunsigned(two, 2).bitwiseAND(fours)


def cells(prints: DataFrame, bits: int = SEGMENT) -> DataFrame:
    """(cell, fp): each distinct fingerprint in its cell and in those at Manhattan distance 1, in the grid of segments of ``bits`` bits."""
    at, near = F.col("counts"), []
    for shift in range(0, 64, bits):
        count = F.shiftrightunsigned(at, shift).bitwiseAND(F.lit((1 << bits) - 1))
        for step in (1, -1):
            # a count c becomes c + step: the bits in which the two differ are turned
            turned = F.lit(None).cast("long")
            for c in range(bits + 1):
                if 0 <= c + step <= bits:
                    turned = F.when(count == c, F.lit(_signed((c ^ c + step) << shift))).otherwise(turned)
            near.append(at.bitwiseXOR(turned))
    return prints.select("fp", segment_counts(F.col("fp"), bits).alias("counts")).select(F.explode(F.array_compact(F.array(at, *near))).alias("cell"), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LINKS = "a long, b long"


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links of a cell: pairs whose segment counts allow it are compared exactly; of the pairs that hold, a spanning forest."""
    n = len(prints)
    shift = np.arange(0, 64, SEGMENT, dtype=np.uint64)
    counts = np.bitwise_count(prints[:, None] >> shift & np.uint64((1 << SEGMENT) - 1)).astype(np.int8)
    i, j = np.triu_indices(n, 1)
    maybe = np.abs(counts[i] - counts[j]).sum(axis=1) <= DISTANCE
    i, j = i[maybe], j[maybe]
    true = np.bitwise_count(prints[i] ^ prints[j]) <= DISTANCE
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i[true].tolist(), j[true].tolist(), strict=True):
        if (a := find(x)) != (b := find(y)):
            root[b] = a
            out.append((x, y))
    return out


def compare(grid: DataFrame, most: int = CELL) -> DataFrame:
    """Links (a, b) of cells of at most ``most`` fingerprints; members of larger cells come as (fp, null).

    Rows come as a stream sorted by cell, so a cell needs the memory of ``most`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, large = None, [], False

        def done() -> list[tuple[int, int | None]]:
            if large or len(held) < 2:
                return []
            prints = np.array(held, np.int64)
            return [(held[x], held[y]) for x, y in _forest(prints.view(np.uint64))]

        for batch in batches:
            at, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(at)))
            out: list[tuple[int, int | None]] = []
            # single fingerprints in the middle of a batch need nothing
            for k in np.unique(np.concatenate([[0, len(starts) - 1], np.flatnonzero(sizes > 1)])).tolist():
                own, members = int(at[starts[k]]), fp[starts[k] : starts[k] + sizes[k]].tolist()
                if own != cell:
                    out += done()
                    cell, held, large = own, [], False
                held += members
                if len(held) > most or large:
                    out += [(x, None) for x in held]
                    held, large = [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        out = done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return grid.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, LINKS)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join all that are within ``DISTANCE`` bits; full cells go to the next finer grid."""
    found, left = [], prints
    for bits in FINER[:-1]:
        met = written(compare(cells(left, bits)), f"met-{bits}")
        found.append(met.where("b is not null").select("a", "b"))
        left = met.where("b is null").select(F.col("a").alias("fp")).distinct()
        if left.isEmpty():
            return reduce(DataFrame.union, found).distinct()
    near = cells(left, FINER[-1])
    least = near.groupBy("cell").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("cell", "least")
    found.append(near.join(least, "cell").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")))
    return reduce(DataFrame.union, found).distinct()


def placed(docs: DataFrame) -> DataFrame:
    """The rows of ``fingerprints`` with the root and the component_id of their component."""
    of_docs = written(fingerprints(docs), "fingerprints")
    prints = written(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "distinct-fingerprints")
    return with_components(of_docs, prints, components(links(prints.select("fp"))))


def with_components(of_docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``of_docs`` with the root and the component_id (its smallest id) of each row's component; ``prints``: (fp, first_id, rows). Fingerprints of
    very many rows and components of very many fingerprints are not gathered in one task."""
    rooted = written(prints.join(roots, prints.fp == roots.node, "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints")), "components")
    every = written(looked_up(rooted, smallest, ["root"], max(1, rooted.count() // HOT_SHARE), "prints").select("fp", "root", "component_id", "rows"), "named")
    return looked_up(of_docs, every, ["fp"], max(1, of_docs.count() // HOT_SHARE), "rows").drop("rows")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id."""
    return placed(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, place: Callable[[DataFrame], DataFrame] = placed) -> DataFrame:
    """One row of ``docs`` of each component by ``place``, with all its columns: that of the smallest id, and of the texts that share this
    id in the component that of the least hash; rows without an id stay. Repeated rows (one id and one text) become one. What ``place`` has written goes."""
    with passing(docs.sparkSession) as keep:
        least = place(docs).where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select("kept.*").distinct()
        least = keep(written(least, "kept"))
    key, mark, digest = (fresh(f"near_{c}", docs) for c in ("id", "hash", "digest"))
    text = F.col("text").cast("string")
    named_rows = docs.where("doc_id is not null").select("*", F.col("doc_id").cast("long").alias(key), F.xxhash64(text).alias(mark), F.md5(text).alias(digest))
    own = named_rows.join(least.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)), [key, mark], "left_semi").dropDuplicates([key, mark, digest])
    return own.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
