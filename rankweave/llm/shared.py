"""Small helpers of the subpackage: tables in the shared folder, and Arrow batches as row dictionaries."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: Spark's bound of a batch on its way to Python. It is 64 MB unless set, which each task holds in the JVM (as much as twice, and its buffers stay) and in Python.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
HOT_SHARE = 1000
#: Bits of a bitmap row of Spark (``bitmap_construct_agg``), keys for each of them, and rows at most (16 MB).
BITMAP_BITS, BITMAP_KEYS, BITMAPS = 32768, 2048, 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all runs on one machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            spark.sparkContext.setCheckpointDir(folder)
            folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands Python batches of about ``BATCH_BYTES``, where the session sets no bound of its own."""
    if spark.conf.get(ARROW_BYTES, None) is not None:
        yield
        return
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES)


#: Where the tables of ``written`` lie, and the tables that open ``passing`` blocks have seen.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_passing: list[list[str]] = []


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        _removed(df.sparkSession, _folders.pop(df))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written meanwhile are deleted at the end, but for those that the function given is called with."""
    seen: list[str] = []
    kept: list[str] = []
    _passing.append(seen)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_folders[df])
        return df

    try:
        yield keep
    finally:
        _passing.pop()
        if _passing:
            _passing[-1] += kept
        for folder in seen:
            if folder not in kept:
                _removed(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if _passing:
        _passing[-1].append(path)
    with small_arrow_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _folders[out] = path
    return out


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], least: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each key and in ``n`` how many of ``rows`` have it. Keys with more than ``least`` rows
    are broadcast: with ``least`` a thousandth of the rows there are fewer than a thousand of them. The others are shuffled. Both sides are read twice."""
    hot, calm = values.where(F.col(n) > least), values.where(F.col(n) <= least)
    few = F.broadcast(hot.select(*keys))
    met = rows.join(F.broadcast(hot), keys)
    return met.unionByName(rows.join(few, keys, "left_anti").join(calm, keys, how))


def likely(rows: DataFrame, wanted: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose long ``key`` is in the table ``wanted``, and a few others: 6 % of them, more where ``wanted`` has over 8 million rows. A bitmap of hashes is
    broadcast, so rows that aren't wanted needn't move to be joined; the join that follows decides. With ``how`` left_anti the other rows."""
    n = min(BITMAPS, wanted.count() // BITMAP_KEYS + 1)
    place = F.pmod(F.xxhash64(key), F.lit(n * BITMAP_BITS))
    bits = wanted.select(place.alias("place")).groupBy(F.floor(F.col("place") / BITMAP_BITS).alias("bitmap")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits"))
    bitmap, at, octet = (fresh(c, rows) for c in ("bitmap_", "place_", "octet_"))
    placed = rows.withColumn(at, place).withColumn(bitmap, F.floor(F.col(at) / BITMAP_BITS))
    of = F.conv(F.hex(F.substring(F.col(octet), (F.col(at) % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = F.broadcast(bits.select(F.col("bitmap").alias(f"{bitmap}_"), F.col("bits").alias(octet)))
    return placed.join(held, (F.col(bitmap) == F.col(f"{bitmap}_")) & F.getbit(of, (F.col(at) % 8).cast("int")).cast("boolean"), how).drop(at, bitmap)


def idle() -> None:
    """At the end of a task: give memory that isn't used back to the system, as idle Python workers stay for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_small_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text or binary column holds about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        if col.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.binary_length(col).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, big: str) -> DataFrame:
    """``work`` gets one bounded Arrow batch and returns the columns of ``schema``; ``big`` names the column that bounds a batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    place = df.columns.index(big)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, place):
            got = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        idle()

    return df.mapInArrow(run, schema)
