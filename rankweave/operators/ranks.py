"""Exact places of rows in one order of all, without a task that holds or orders them all.

Rows are counted in units of a bounded number of rows, the counts are summed up on two levels (parts, and the units of a part), and a row's place is what lies
ahead of its unit plus its place within. Ties make no large unit: rows of one value are counted in runs of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.sharded import checkpointed
from rankweave.operators.weights import beside

PARTS = 256
RUN = 1 << 16


def running(units: DataFrame, *order: Column) -> DataFrame:
    """``units`` (part, n, ...) with ``before``, the sum of n of all units ahead, and ``total``. Parts are numbers, at most PARTS of them, that
    ascend with ``order``."""
    sums = units.groupBy("part").agg(F.sum("n").alias("n")).groupBy().agg(F.collect_list(F.struct("part", "n")).alias("sums"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def added(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    met = beside(units.withColumn("before", within), sums)
    ahead = F.filter("sums", lambda x: x["part"] < F.col("part"))
    return met.withColumn("before", F.col("before") + added(ahead)).withColumn("total", added(F.col("sums"))).drop("sums")


def places_by_hash(rows: DataFrame, key: Column) -> DataFrame:
    """(id, place): places from 0 in the order of ``key``, a hash in hexadecimal digits, then id. Its first four digits are the unit (so the counts that every
    task gets are 65,536 at most), the first two the part."""
    of = rows.select("id", key.alias("key"), F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("unit"))
    units = of.groupBy("unit").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("unit") / PARTS).cast("int"))
    starts = running(units, F.col("unit")).select("unit", "before")
    within = F.row_number().over(Window.partitionBy("unit").orderBy("key", "id"))
    return of.withColumn("within", within).join(F.broadcast(starts), "unit").select("id", (F.col("before") + F.col("within") - 1).alias("place"))


def _counted(scores: DataFrame, name: str, best_first: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (fid, score, part, unit) and units (part, unit, n, before, total) in the order of score and runs of fid. Parts are ranges between quantiles, PARTS - 1 numbers that
    go through the driver once, so that every reading deals alike; scores are written first, since sums of doubles may differ when made again."""
    kept = checkpointed(scores.select("fid", F.col(name).cast("double").alias("score")))
    at = kept.where(~F.isnan("score")).agg(F.percentile_approx("score", [i / PARTS for i in range(1, PARTS)]).alias("at")).first()["at"]
    bounds = F.array(*[F.lit(x).cast("double") for x in sorted(set(at or []))]).cast("array<double>")
    part = F.size(F.filter(bounds, lambda b: b < F.col("score")))
    rows = kept.withColumn("part", PARTS - part if best_first else part).withColumn("unit", F.struct("score", F.floor(F.col("fid") / RUN).alias("run")))
    units = rows.groupBy("part", "unit").agg(F.count("*").alias("n"))
    score = F.col("unit.score")
    return rows, running(units, score.desc() if best_first else score.asc(), F.col("unit.run"))


def places(scores: DataFrame, name: str = "score") -> DataFrame:
    """(fid, score, place): places from 0, greatest score first, ties to the smaller fid; null comes last."""
    rows, units = _counted(scores, name, True)
    within = F.row_number().over(Window.partitionBy("part", "unit").orderBy("fid"))
    met = rows.withColumn("within", within).join(units.select("part", "unit", "before"), ["part", "unit"])
    return met.select("fid", "score", (F.col("before") + F.col("within") - 1).alias("place"))


def tied_places(scores: DataFrame, name: str = "score") -> DataFrame:
    """(fid, score, place, total): places from 1, smallest score first; rows of one score share the mean of their places. Null is a score below all."""
    rows, units = _counted(scores, name, False)
    same = Window.partitionBy("part", "unit.score")
    tied = units.select("part", "unit", (F.min("before").over(same) + (F.sum("n").over(same) + 1) / 2).alias("place"), "total")
    return rows.join(tied, ["part", "unit"]).select("fid", "score", "place", "total")
