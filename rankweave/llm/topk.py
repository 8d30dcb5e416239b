"""Exact top-k search by inner product with an impact-ordered index, score at a time.

Vectors become integers. In each block of vectors a component has two posting lists, one by how far it lies above the block's least value and
one by how far it lies below the greatest, so every impact is a distance of at least 0 and a query meets exactly one of the two lists of each
component. Impacts are quantised to levels; a list's postings lie in segments by level. A batch of queries processes the segments of all lists
by descending level; it keeps for every vector the sum of the levels seen and the query weight they cover, which bound the vector's score from
both sides. A query's floor is a score that k others are known to reach: the k-th of the first block at the start, raised by the exact scores
of the vectors that are ahead. A batch stops only on proof, when few vectors have an upper bound that reaches the floor; these possible members
are scored exactly. Each block gives those of its exact top k that reach the floor, and the top k of all is the answer.

Vectors that are null or hold null or non-finite components take no part. Vectors are compared with those of equal length. A query's own row is
the row with its id; repeated rows are candidates of their own, repeated queries are asked once. Ties go to the smaller id. Scores beyond 2**53
are outside the contract. An empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.shared import table, written

K = 20
EVERY = 20
SCALE = 64
BLOCK = 8192
QUERIES = 512
AT_ONCE = 128
LEVELS = 128
FEW = 0.05
FIRST = 0.4
CHECK = 0.05
PAIRS = 1 << 16
NONE = -(1 << 62)

FOUND = "query_id long, query_key long, vec_id long, score long"


@dataclass
class Block:
    """Impact-ordered postings of some vectors. List d holds how far component d lies above the block's least value, list d plus the number of
    dimensions how far it lies below the greatest. ``postings``: per list the vectors' places, from the highest level down; ``ends``: per list
    and level, where the postings of higher levels and of this one end; ``levels``: the level of each vector in each list."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    step: int
    top: int
    postings: np.ndarray
    ends: np.ndarray
    levels: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray) -> Block:
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    step = max(1, ceil((int((high - low).max(initial=0)) + 1) / LEVELS))
    levels = (np.concatenate([vectors - low, high - vectors], axis=1) // step).T
    top = int(levels.max(initial=0))
    postings = np.argsort(-levels, axis=1, kind="stable").astype(np.int32)
    # counts of levels from the highest down
    ends = np.stack([np.bincount(top - x, minlength=top + 1).cumsum() for x in levels]) if len(levels) else np.zeros((0, top + 1), int)
    return Block(ids, vectors, low, high, step, top, postings, ends, levels.astype(np.int16))


def _exact(block: Block, queries: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of pairs of a query and a vector."""
    out = np.empty(len(q), np.int64)
    for at in range(0, len(q), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = np.einsum("pd,pd->p", queries[q[some]], block.vectors[rows[some]])
    return out


def search(block: Block, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Of each query: ids and exact scores of those of the block's top k that reach the query's floor, a score that k others are known to reach;
    and the share of the postings that were processed."""
    n, m = len(block.ids), len(queries)
    weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
    whole = weights.sum(axis=1)
    # a score is this much more than the sum of its distances
    base = np.maximum(queries, 0) @ block.low - np.maximum(-queries, 0) @ block.high
    exact = np.float32 if whole.max(initial=0) * (LEVELS + 1) < 1 << 24 else np.float64
    floors = np.full(m, NONE) if floors is None else floors.copy()
    own = query_ids[:, None] == block.ids[None, :]
    sums = np.zeros((n, m), exact)
    lists = [(d, w.astype(exact)) for d, w in enumerate(weights.T) if w.any()]
    total = n * len(lists)
    done, checked = 0, 0.0
    candidates = ~own
    for level in range(block.top, 0, -1):
        at = block.top - level
        for d, w in lists:
            start, end = block.ends[d, at - 1] if at else 0, block.ends[d, at]
            if end > start:
                sums[block.postings[d, start:end]] += w * exact(level)
                done += end - start
        if level > 1 and (done < (checked + CHECK) * total or done < FIRST * total):
            continue
        checked = done / total
        seen = weights.astype(exact) @ (block.levels >= level).astype(exact)
        lower = sums.T.astype(np.float64) * block.step + base[:, None]
        # what isn't seen has a level below this one
        upper = lower + seen * (block.step - 1.0) + (whole[:, None] - seen) * (level * block.step - 1.0)
        if n > 2 * k:
            # the vectors that are ahead, scored exactly, raise the floor
            ahead = np.argpartition(np.where(own, -np.inf, lower), n - 2 * k, axis=1)[:, n - 2 * k :]
            q = np.repeat(np.arange(m), 2 * k)
            scores = np.where(own[q, ahead.ravel()], NONE, _exact(block, queries, q, ahead.ravel())).reshape(m, 2 * k)
            floors = np.maximum(floors, np.partition(scores, k, axis=1)[:, k])
        candidates = (upper >= floors[:, None]) & ~own
        if candidates.mean() <= FEW:
            break
    q, rows = np.nonzero(candidates)
    scores = _exact(block, queries, q, rows)
    reach = scores >= floors[q]
    q, ids, scores = q[reach], block.ids[rows[reach]], scores[reach]
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.searchsorted(q, np.arange(m + 1))
    found = [(ids[a:b][:k], scores[a:b][:k]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return found, done / total if total else 0.0


def integer_vector(embedding: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component x; null for vectors that take no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _blocks(rows: DataFrame, size: int, n: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows, dealt in turn; their ids, keys, floors and components in arrays."""
    many = max(1, ceil(n / size))
    dealt = rows.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(many)))
    gathered = dealt.groupBy(name, "size").agg(F.collect_list(F.struct("vec_id", "key", "floor", "vector")).alias("held"))
    return gathered.select(name, "size", *(F.col(f"held.{c}").alias(f"{name}_{c}s") for c in ("vec_id", "key", "floor")), F.flatten("held.vector").alias(f"{name}_values"))


def _found(index: DataFrame, asked: DataFrame, n_asked: int, numbers: Column, shares: int, k: int) -> DataFrame:
    """(query_id, query_key, vec_id, score): what the queries find in the blocks of these numbers. The batches that meet a block are dealt over
    as many ``shares``, each with a copy of the block, so that few blocks don't mean few tasks."""
    batches = _blocks(asked, QUERIES, n_asked, "batch").withColumn("block", F.explode(numbers.cast("array<long>"))).withColumn("share", F.pmod("batch", F.lit(shares)))
    index = index.withColumn("number", numbers.cast("array<long>")).where(F.array_contains("number", F.col("block"))).drop("number").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = place = None
        for part in parts:
            for i in range(part.num_rows):
                number, size, ids, values, query_ids, keys, floors, query_values = (part.column(c)[i] for c in range(8))
                if place != (number.as_py(), size.as_py()):
                    place = (number.as_py(), size.as_py())
                    block = build(ids.values.to_numpy(), values.values.to_numpy().reshape(len(ids), place[1]))
                asks = query_values.values.to_numpy().reshape(len(query_ids), place[1])
                q_ids, q_keys, q_floors = (x.values.to_numpy() for x in (query_ids, keys, floors))
                for at in range(0, len(asks), AT_ONCE):
                    some = slice(at, at + AT_ONCE)
                    found, _ = search(block, q_ids[some], asks[some], k, q_floors[some])
                    out = [(np.full(len(v), q_ids[at + q]), np.full(len(v), q_keys[at + q]), v, s) for q, (v, s) in enumerate(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["query_id", "query_key", "vec_id", "score"])

    met = index.join(batches, ["block", "size", "share"])
    return met.select("block", "size", "block_vec_ids", "block_values", "batch_vec_ids", "batch_keys", "batch_floors", "batch_values").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, vector of longs) that ``queries`` chooses, the k best others."""
    fit = written(
        vectors.where("vector is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("size"), F.xxhash64("vector").alias("key"), F.lit(NONE).alias("floor")), "vectors"
    )
    asked = fit.where(queries).dropDuplicates(["vec_id", "key"])
    n, n_asked = fit.count(), asked.count()
    many = max(1, ceil(n / BLOCK))
    index = _blocks(fit, BLOCK, n, "block")
    n_batches = max(1, ceil(n_asked / QUERIES))
    found = _found(index, asked, n_asked, F.array(F.lit(0)), n_batches, k)
    if many > 1:
        # the k-th score of the first block is the floor of the search in all others
        index = written(index, "index")
        first = written(_found(index, asked, n_asked, F.array(F.lit(0)), n_batches, k), "first-block")
        floors = first.groupBy(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
        begun = asked.join(floors, ["vec_id", "key"], "left").withColumn("floor", F.coalesce("reached", "floor")).drop("reached")
        found = first.unionByName(_found(index, begun, n_asked, F.sequence(F.lit(1), F.lit(many - 1)), 1, k))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector, the 20 vectors with the greatest inner product."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integer_vector(F.col("embedding")).alias("vector"))
    return top_k(rows, F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
  WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
