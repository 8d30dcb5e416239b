"""Folds, thresholded predictions, F1 scores and the search for capacities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.fusion import best_capacities, fuse_grid, n_selected
from rankweave.operators.mlknn import adaptive_k, label_totals
from rankweave.operators.ranks import places_by_hash
from rankweave.operators.sharded import checkpointed
from rankweave.operators.shared_tiles import subset_counts
from rankweave.plans.params import MlknnParams, SelectionParams, params_of


def folds(samples: DataFrame, cv: int = 3, seed: int = 42) -> DataFrame:
    """(id, fold): all rows in the order of a hash of seed and id, dealt in turn; no task orders all rows."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return places_by_hash(samples, key).select("id", (F.col("place") % cv).cast("int").alias("fold"))


def thresholded(proba: DataFrame, least: float = 0.5) -> DataFrame:
    return proba.withColumn("pred", (F.col("proba") >= least).cast("int"))


def paired(pred: DataFrame, samples: DataFrame) -> DataFrame:
    """Predictions with the truth ``y``."""
    return pred.join(samples.select("id", F.posexplode("labels").alias("lid", "y")), ["id", "lid"])


def weight(rows: DataFrame) -> Column:
    """How many rows a row stands for: its ``n``, or one."""
    return F.col("n") if "n" in rows.columns else F.lit(1)


def micro_f1(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, micro) of rows (pred, y), or (pred, y, n)."""
    n = weight(rows)
    sums = rows.groupBy(*keys).agg(F.sum(n * F.col("pred") * F.col("y")).alias("tp"), F.sum(n * F.col("pred")).alias("p"), F.sum(n * F.col("y")).alias("t"))
    tiny = F.lit(1e-12)
    precision, recall = F.col("tp") / F.greatest("p", tiny), F.col("tp") / F.greatest("t", tiny)
    return sums.select(*keys, (2 * precision * recall / F.greatest(precision + recall, tiny)).alias("micro"))


def macro_f1(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, macro): mean over labels that are predicted or true somewhere; 0 if there are none."""
    n = weight(rows)
    sums = rows.groupBy(*keys, "lid").agg(F.sum(n * F.col("pred") * F.col("y")).alias("tp"), F.sum(n * (F.col("pred") + F.col("y"))).alias("both"))
    return sums.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both"))), F.lit(0.0)).alias("macro"))


def geometric_mean(micro: DataFrame, macro: DataFrame, key: str) -> DataFrame:
    """(key, gm) of fold scores (key, fold, micro) and (key, fold, macro)."""
    means = micro.join(macro, [key, "fold"]).groupBy(key).agg(F.avg("micro").alias("mi"), F.avg("macro").alias("ma"))
    return means.select(key, F.sqrt(F.greatest("mi", F.lit(0.0)) * F.greatest("ma", F.lit(0.0))).alias("gm"))


@dataclass(frozen=True)
class Judged:
    """What the classifiers of all feature subsets and folds say: ``counts`` (s, n, ids, folds, y, c) as of ``subset_counts``; ``cells`` (subset, fold, lid, c, y, n, pred):
    how many test rows have so many neighbours with the label, their truth and the prediction, which follows from the count."""

    names: list[str]
    n_labels: int
    counts: DataFrame
    cells: DataFrame

    @property
    def outcomes(self) -> DataFrame:
        """(subset, fold, lid, pred, y, n): how many test rows; no row of its own for each of them."""
        return self.cells.drop("c")


def judged(samples: DataFrame, groups: DataFrame, params: MlknnParams, cv: int, seed: int) -> Judged:
    """Every row judged by the classifier of its fold, for each feature subset in ``groups`` (subset, selected array<int>; one for each pair of capacities at most). Rows
    meet once for all subsets and folds; what a classifier is made of are tallies of counts, added up where the counts are made."""
    first = samples.select(F.size("labels")).first()
    n_labels = first[0] if first else 0
    dealt = samples.join(folds(samples, cv, seed), "id").select("id", "fold", "features", "labels")
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    k = min(params.k, max(1, sum(sizes) - max(sizes, default=0) - 1))
    chosen = {g["subset"]: list(g["selected"]) for g in groups.orderBy("subset").collect()}
    limits = None
    if params.label_adaptive_k:
        every = dealt.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(cv - 1)))).select("grp", "labels", (F.col("fold") != F.col("grp")).alias("train"))
        limits = np.full((cv, n_labels), k)
        for r in adaptive_k(label_totals(every), MlknnParams(k, params.s, True, min(params.label_k_min, k), params.label_k_power)).collect():
            limits[r["grp"], r["lid"]] = r["k"]
    counts = checkpointed(subset_counts(dealt, list(chosen.values()), cv, k, limits))

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, y, c = block_counts(batch.slice(i, 1), cv, n_labels)
                for t in range(cv):
                    test = (of["folds"] == t)[:, None]
                    place = ((np.where(test, 1, 0) * n_labels + np.arange(n_labels)) * 2 + y) * (k + 1) + np.maximum(c[:, t], 0)
                    tally = np.bincount(place[~(test & (c[:, t] < 0))], minlength=1)
                    at = np.flatnonzero(tally)
                    rest, near = np.divmod(at, k + 1)
                    rest, truth = np.divmod(rest, 2)
                    test, lid = np.divmod(rest, n_labels)
                    columns = [np.full(len(at), of["s"]), np.full(len(at), t), test, lid, truth, near]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in columns), pa.array(tally[at])], ["s", "fold", "test", "lid", "y", "c", "n"])

    tally = counts.mapInArrow(tallies, "s int, fold int, test int, lid int, y int, c int, n long").groupBy("s", "fold", "test", "lid", "y", "c").agg(F.sum("n").alias("n"))
    same, cell, learnt = Window.partitionBy("s", "fold", "lid"), Window.partitionBy("s", "fold", "lid", "c"), F.col("test") == 0
    ones, zeros, a = F.when(learnt, F.col("n") * F.col("y")).otherwise(0), F.when(learnt, F.col("n") * (1 - F.col("y"))).otherwise(0), params.s
    known = tally.select("*", F.sum(ones).over(same).alias("pos"), F.sum(zeros).over(same).alias("neg"), F.sum(ones).over(cell).alias("ct"), F.sum(zeros).over(cell).alias("cf")).where("test = 1")
    looked = F.lit(k) if limits is None else F.element_at(F.element_at(F.lit(limits.tolist()), F.col("fold") + 1), F.col("lid") + 1)
    p1 = (a + F.col("pos")) / (2 * a + F.col("pos") + F.col("neg"))
    room = a * (looked + 1)
    pt, pf = p1 * ((a + F.col("ct")) / (room + F.col("pos"))), (1 - p1) * ((a + F.col("cf")) / (room + F.col("neg")))
    proba = F.when(looked <= 0, p1).when(pt + pf == 0, 0.5).otherwise(pt / (pt + pf))
    subset = F.element_at(F.array(*map(F.lit, chosen)), F.col("s") + 1).alias("subset") if chosen else F.lit("").alias("subset")
    return Judged(list(chosen), n_labels, counts, thresholded(known.withColumn("proba", proba)).select(subset, "fold", "lid", "c", "y", "n", "pred"))


def block_counts(block: pa.RecordBatch, cv: int, n_labels: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """(s, ids and folds, labels, counts) of one block of ``subset_counts``."""
    n = block.column(1)[0].as_py()
    ids, of, y, c = (np.frombuffer(block.column(i)[0].as_buffer(), kind) for i, kind in ((2, np.int64), (3, np.int32), (4, np.uint8), (5, np.int32)))
    return {"s": block.column(0)[0].as_py(), "ids": ids, "folds": of}, y.reshape(n, -1)[:, :n_labels], c.reshape(n, cv, -1)[:, :, :n_labels]


def fold_predictions(samples: DataFrame, groups: DataFrame, params: MlknnParams, cv: int, seed: int) -> DataFrame:
    """(subset, fold, id, lid, pred, y): what ``judged`` says, row by row."""
    of = judged(samples, groups, params, cv, seed)
    names, n_labels = of.names, of.n_labels

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, y, c = block_counts(batch.slice(i, 1), cv, n_labels)
                own = c[np.arange(len(y)), block["folds"]]
                row, lid = np.nonzero(own >= 0)
                name = pa.array([names[block["s"]]] * len(row), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(block["folds"][row]), pa.array(block["ids"][row]), *(pa.array(x.astype(np.int32)) for x in (lid, own[row, lid], y[row, lid]))], ["subset", "fold", "id", "lid", "c", "y"])

    each = of.counts.mapInArrow(rows, "subset string, fold int, id long, lid int, c int, y int")
    said = of.cells.select("subset", "fold", "lid", "c", "pred").distinct()
    return each.join(F.broadcast(said), ["subset", "fold", "lid", "c"]).select("subset", "fold", "id", "lid", "pred", "y")


def capacity_scores(samples: DataFrame, embedded: DataFrame, spectral: DataFrame, params: SelectionParams | dict | None = None) -> DataFrame:
    """(mu_e, mu_s, gm): the cross-validated score of every pair of capacities; pairs that select the same features are judged once."""
    p = params_of(SelectionParams, params)
    fused = fuse_grid(embedded, spectral, p.grid)
    k = n_selected(embedded.count(), p.p_frac)
    r = F.row_number().over(Window.partitionBy("mu_e", "mu_s").orderBy(F.desc("score"), "fid"))
    chosen = fused.withColumn("r", r).where(F.col("r") <= k).groupBy("mu_e", "mu_s").agg(F.sort_array(F.collect_list("fid")).alias("selected")).withColumn("subset", F.array_join(F.col("selected").cast("array<string>"), ","))
    rows = checkpointed(judged(samples, chosen.select("subset", "selected").distinct(), MlknnParams(k=p.mlknn_k, label_k_min=min(3, p.mlknn_k)), p.cv, p.seed).outcomes)
    gm = geometric_mean(micro_f1(rows, "subset", "fold"), macro_f1(rows, "subset", "fold"), "subset")
    return chosen.join(gm, "subset").select("mu_e", "mu_s", "gm")


def select_capacities(samples: DataFrame, embedded: DataFrame, spectral: DataFrame, params: SelectionParams | dict | None = None) -> tuple[float, float, float]:
    best = best_capacities(capacity_scores(samples, embedded, spectral, params)).first()
    return (best["mu_e"], best["mu_s"], best["gm"]) if best else (0.5, 0.5, -1.0)
