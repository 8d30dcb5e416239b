"""Token-id output: fixed-size id blocks, transposed into bit or byte planes, each plane compressed with zstandard, with a chunk index.

The file format is a Parquet table of shards. A shard is a run of whole documents in ascending order of doc_id (rows that share an id: of a hash of
their text, then of the text; only ids and hashes are sampled for the ranges, so no text goes to the driver); its ``payload``
holds the compressed planes of its blocks one after another, ``chunk_index`` says where each block starts, how many ids it holds and how
long its planes are, and ``doc_ids`` with ``doc_tokens`` say which ids are whose. Spark's committer makes the files appear whole or not
at all, so a lost executor leaves no half-written shard, and any store that Spark can write to will do.

Null texts count as empty, null doc_ids come first, repeated rows are written as often as they come, an empty table gives an empty store,
and further columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import in_small_batches, shared_folder, table
from rankweave.llm.units import library_memo

BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20
END_ID = 2
LEVEL = 3
UNITS_KEPT = 1_000_000

SHARDS = (
    "part int, shard int, n_ids long, doc_ids array<long>, doc_tokens array<int>,"
    " chunk_index array<struct<at:long,n_ids:int,planes:array<int>>>, payload binary"
)
DOCS = "part int, shard int, place int, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """A block of unsigned 32-bit ids as 4 byte planes or 32 bit planes, compressed each; trailing planes of zeros are left out."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        bits = np.unpackbits(cells, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(cells[:, k]) for k in range(4)]
    while planes and not planes[-1].any():
        planes.pop()
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return [packer.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids of a block from its compressed planes."""
    opener = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(opener.decompress(p, max_output_size=max(n, 1)), np.uint8) for p in planes]
    if kind == "bit":
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(raw):
            bits[:, k] = np.unpackbits(p, count=n, bitorder="little")
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)
    cells = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(raw):
        cells[:, k] = p
    return cells.view("<u4").reshape(-1)


class _Shard:
    """Whole documents, gathered until there are enough ids."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[bytes] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.parts.append(ids)
        self.n += len(ids) // 4

    def row(self, part: int, shard: int, kind: str) -> dict:
        ids, index, payload = np.frombuffer(b"".join(self.parts), "<u4"), [], []
        at = 0
        for start in range(0, len(ids), BLOCK_IDS):
            block = ids[start : start + BLOCK_IDS]
            planes = to_planes(block, kind)
            index.append({"at": at, "n_ids": len(block), "planes": [len(p) for p in planes]})
            payload += planes
            at += sum(map(len, planes))
        return {"part": part, "shard": shard, "n_ids": self.n, "doc_ids": self.docs, "doc_tokens": self.sizes, "chunk_index": index, "payload": b"".join(payload)}


def read_block(payload: bytes | memoryview, entry: dict, kind: str) -> np.ndarray:
    """One block of a shard by its entry of the chunk index: nothing else of the payload is decompressed."""
    planes, at = [], entry["at"]
    for n in entry["planes"]:
        planes.append(payload[at : at + n])
        at += n
    return from_planes(planes, entry["n_ids"], kind)


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write the shards to ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SHARDS))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, memo, shard, n = TaskContext.get().partitionId(), library_memo(tokenizer, joined=True, full=UNITS_KEPT), _Shard(), 0
        for batch in in_small_batches(batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), memo.ids(batch.column(1).to_pylist()), strict=True):
                shard.add(doc_id, ids.tobytes() + end)
                if shard.n >= SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([shard.row(part, n, kind)], schema)
                    shard, n = _Shard(), n + 1
        if shard.docs:
            yield pa.RecordBatch.from_pylist([shard.row(part, n, kind)], schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    first = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ranged = rows.repartitionByRange(*first).sortWithinPartitions(*first, "text").select("doc_id", "text")
    ranged.mapInArrow(encode, SHARDS).write.parquet(path)


def read_store(spark: SparkSession, path: str, kind: str = "byte") -> DataFrame:
    """Per document of the store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 - decoded from the files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DOCS))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, shard, _, doc_ids, doc_tokens, index, payload = (c[i] for c in batch.columns)
                planes = memoryview(payload.as_buffer())
                blocks = [read_block(planes, x, kind) for x in index.as_py()]
                raw = memoryview(np.concatenate([np.zeros(0, "<u4"), *blocks]).astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(np.append(0, doc_tokens.values.to_numpy()))
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                k = len(crcs)
                columns = (np.full(k, part.as_py()), np.full(k, shard.as_py()), np.arange(k), doc_ids.values, ends[:-1], doc_tokens.values, crcs)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v.cast(f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    shards = spark.read.schema(SHARDS).parquet(path)
    # starts by two levels of prefix sums: over the parts, and over the shards of each part
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    docs = shards.mapInArrow(decode, DOCS)
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as byte planes and read them back from the files."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path)
