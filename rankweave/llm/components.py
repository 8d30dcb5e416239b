"""Connected components of links between long ids, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import HOT_SHARE, idle, looked_up, written

#: So many links (2 MB) are settled in one step by one task; more of them in rounds.
FEW = 1 << 17


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], ["node", "root"])
    idle()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root): the least node that can be reached from each node that has a link.

    Every round takes the least root among a node's neighbours and then the root of that root, so paths halve at least; each round is
    written to the shared folder. Rounds end when no root changes. Nodes and roots that hold over one in ``HOT_SHARE`` of all rows (so fewer than
    ``HOT_SHARE`` of them) are looked up by broadcast, so that no task gets all rows of one. At most ``FEW`` links need no rounds.
    """
    some = written(links.where("a <> b").select("a", "b"), "some-links")
    if some.count() <= FEW:
        return written(some.repartition(1).mapInArrow(_settled, "node long, root long"), "roots")
    both = written(some.select("a", "b").union(some.select("b", "a")).distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    least = max(1, both.count() // HOT_SHARE)
    degrees = written(both.groupBy("b").agg(F.count("*").alias("n")), "degrees")
    while True:
        found = looked_up(both, degrees.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b"), ["b"], least)
        near = found.groupBy("a").agg(F.min("near").alias("low"))
        lower = written(roots.join(near, roots.node == near.a, "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("root")), "lower")
        sizes = lower.groupBy("root").agg(F.count("*").alias("n"))
        ends = sizes.join(lower.select(F.col("node").alias("root"), F.col("root").alias("end")), "root")
        new = written(looked_up(lower, ends, ["root"], least).select("node", "was", F.col("end").alias("root")), "roots")
        roots = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return roots
