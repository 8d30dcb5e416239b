"""Feature scores from the label-affinity graph.

The affinity of two rows depends only on their label patterns, so energies and kernel alignments are exact sums over patterns. Cosine and Hamming
affinities are sums of a few products of one number of either pattern (``Factored``): their graphs are never written out, and all sums are taken label by
label. Jaccard affinities (``Graph``) have no such form: patterns meet by an equi-join on labels in common, never in a cross join. A graph over rows
is only made where each row keeps its k nearest neighbours. A node stands for n rows; ``own`` corrects what a row's pair with itself adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.columns import pattern, scaled
from rankweave.operators.weights import pattern_counts, spectral_pattern_weights
from rankweave.plans.params import SIMILARITIES, SpectralParams, params_of

EPS = 1e-10


def pattern_edges(patterns: DataFrame, sim: str = "jaccard") -> DataFrame:
    """(p, q, w): affinities above zero of ordered pairs of patterns, a pattern with itself included."""
    if sim not in SIMILARITIES:
        raise ValueError(f"label_sim must be one of {SIMILARITIES}")
    long = patterns.select("pattern", F.size("labels").alias("size"), F.posexplode("labels").alias("lid", "y"))
    if sim != "hamming":  # hamming counts labels that both lack, too
        long = long.where("y > 0")
    c = long.groupBy("pattern", "size").agg(F.count("*").alias("c"))
    a, b = long.select(F.col("pattern").alias("p"), "lid", "y"), long.select(F.col("pattern").alias("q"), "lid", "y")
    both = a.join(b, ["lid", "y"]).groupBy("p", "q").agg(F.count("*").alias("both"))
    with_c = both.join(c.select(F.col("pattern").alias("p"), F.col("c").alias("cp"), "size"), "p").join(c.select(F.col("pattern").alias("q"), F.col("c").alias("cq")), "q")
    both, cp, cq = F.col("both"), F.col("cp"), F.col("cq")
    w = {"jaccard": both / F.greatest(cp + cq - both, F.lit(EPS)), "cosine": both / F.sqrt(cp * cq), "hamming": both / F.col("size")}[sim]
    return with_c.select("p", "q", w.cast("double").alias("w"))


class Energies:
    """What follows from ``quadratic()`` of a graph."""

    def scores(self) -> DataFrame:
        """(fid, dirichlet, hsic)."""
        x = self.quadratic()
        n = F.col("rows")
        hsic = F.col("xax") - 2 * F.col("sum_x") * F.col("deg_x") / n + F.col("mass") / (n * n) * F.col("sum_x") * F.col("sum_x")
        return x.select("fid", ((F.col("xx") - F.col("xnx")) / (F.col("xx") + EPS)).alias("dirichlet"), (hsic / (F.col("xx") + EPS)).alias("hsic"))


def _degree(nodes: DataFrame, near: DataFrame, *more: str) -> DataFrame:
    """``nodes`` with weighted degree and its inverse root, 0 for isolated nodes; near: (node, near)."""
    deg = F.coalesce("near", F.lit(0.0)) + F.col("own")
    return nodes.join(near, "node", "left").select("node", "n", "own", deg.alias("deg"), F.when(deg > EPS, 1 / F.sqrt(deg)).otherwise(0.0).alias("d"), *more)


@dataclass(frozen=True)
class Graph(Energies):
    """nodes (node, n, own), edges (p, q, w), stats (node, fid, s, q): per node the sums of weighted values and of their squares."""

    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame

    def degrees(self) -> DataFrame:
        """(node, n, own, deg, d)."""
        near = self.edges.join(self.nodes.select(F.col("node").alias("q"), "n"), "q").groupBy(F.col("p").alias("node")).agg(F.sum(F.col("n") * F.col("w")).alias("near"))
        return _degree(self.nodes, near)

    def quadratic(self) -> DataFrame:
        """(fid, xx, xax, xnx, deg_x, sum_x, rows, mass): the sums from which energies and alignments follow."""
        g = self.degrees()
        of = self.stats.join(g, "node").select("node", "n", "fid", "s", "q", "own", "deg", "d")
        near = self.edges.join(of.select(F.col("node").alias("q"), "fid", "s", "d"), "q").groupBy(F.col("p").alias("node"), "fid").agg(F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum(F.col("w") * F.col("d") * F.col("s")).alias("wds"))
        ws, wds = F.coalesce("ws", F.lit(0.0)), F.coalesce("wds", F.lit(0.0))
        return of.join(near, ["node", "fid"], "left").groupBy("fid").agg(
            F.sum("q").alias("xx"), F.sum(F.col("s") * ws + F.col("own") * F.col("q")).alias("xax"), F.sum(F.col("d") * F.col("s") * wds + F.col("d") * F.col("d") * F.col("own") * F.col("q")).alias("xnx"),
            F.sum(F.col("deg") * F.col("s")).alias("deg_x"), F.sum("s").alias("sum_x"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("deg")).alias("mass"),
        )


@dataclass(frozen=True)
class Factored(Energies):
    """A graph that is never written out: w(p, q) is the sum over keys of coef * u(p) * u(q).

    nodes (node, n, own, factors array<struct<key, u, coef>>; a key has one coef) and stats (node, fid, s, q) as in ``Graph``. A node's factors are
    as many as its labels and two more at most; what is shuffled is one partial sum per key and feature of a partition.
    """

    nodes: DataFrame
    stats: DataFrame

    def degrees(self, *more: str) -> DataFrame:
        """(node, n, own, deg, d)."""
        parts = self.nodes.select("node", "n", F.explode("factors").alias("f")).select("node", "n", "f.*")
        total = parts.groupBy("key").agg(F.sum(F.col("n") * F.col("u") * F.col("coef")).alias("total"))
        near = parts.join(total, "key").groupBy("node").agg(F.sum(F.col("u") * F.col("total")).alias("near"))
        return _degree(self.nodes, near, *more)

    def quadratic(self) -> DataFrame:
        """(fid, xx, xax, xnx, deg_x, sum_x, rows, mass), from one pass: the factor without a key carries what isn't a product of two nodes."""
        plain = F.array(F.struct(F.lit(None).cast("int").alias("key"), F.lit(0.0).alias("u"), F.lit(0.0).alias("coef")))
        of = self.stats.join(self.degrees("factors"), "node").select("n", "fid", "s", "q", "own", "deg", "d", F.explode(F.concat(plain, "factors")).alias("f"))

        def once(v: Column) -> Column:
            return F.sum(F.when(F.col("f.key").isNull(), v))

        s, q, d, n, own = (F.col(c) for c in ("s", "q", "d", "n", "own"))
        sums = of.groupBy("fid", "f.key", "f.coef").agg(
            F.sum(F.col("f.u") * s).alias("us"), F.sum(F.col("f.u") * d * s).alias("uds"), once(q).alias("xx"), once(own * q).alias("own_q"), once(d * d * own * q).alias("own_dq"),
            once(F.col("deg") * s).alias("deg_x"), once(s).alias("sum_x"), once(n).alias("rows"), once(n * F.col("deg")).alias("mass"),
        )
        return sums.groupBy("fid").agg(
            F.sum("xx").alias("xx"), (F.sum(F.col("coef") * F.col("us") * F.col("us")) + F.sum("own_q")).alias("xax"), (F.sum(F.col("coef") * F.col("uds") * F.col("uds")) + F.sum("own_dq")).alias("xnx"),
            F.sum("deg_x").alias("deg_x"), F.sum("sum_x").alias("sum_x"), F.sum("rows").alias("rows"), F.sum("mass").alias("mass"),
        )


def factors(labels: Column, sim: str) -> Column:
    """The factors of a pattern's labels; all rows have equally many labels.

    Cosine: y / sqrt(c) for each label, c the number of positive ones. Hamming, with L labels: agreements are L - c - c' + 2 yy', so a share of
    (1 - c / L)(1 - c' / L) - cc' / L^2 + 2 / L yy', whose first two keys are -1 and -2. Labels that are not positive have no factor.
    """
    size, c = F.greatest(F.size(labels), F.lit(1)).cast("double"), F.size(F.filter(labels, lambda y: y > 0)).cast("double")

    def factor(key: Column, u: Column, coef: Column) -> Column:
        return F.struct(key.alias("key"), u.cast("double").alias("u"), coef.cast("double").alias("coef"))

    u, coef = {"cosine": (1 / F.sqrt(F.greatest(c, F.lit(1.0))), F.lit(1.0)), "hamming": (F.lit(1.0), 2 / size)}[sim]
    each = F.filter(F.transform(labels, lambda y, i: factor(i, F.when(y > 0, u).otherwise(0.0), coef)), lambda f: f["u"] > 0)
    return each if sim == "cosine" else F.concat(F.array(factor(F.lit(-1), 1 - c / size, F.lit(1.0)), factor(F.lit(-2), c, -1 / (size * size))), each)


def value_sums(samples: DataFrame, node: Column, weights: DataFrame | None = None) -> DataFrame:
    """(node, fid, s, q), weights: (pattern, w)."""
    rows = samples.withColumn("pattern", pattern(F.col("labels")))
    if weights is not None:
        rows = rows.join(weights.select("pattern", "w"), "pattern").withColumn("features", scaled(F.col("features"), F.col("w")))
    return rows.select(node.alias("node"), F.posexplode("features").alias("fid", "val")).groupBy("node", "fid").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))


def label_graph(samples: DataFrame, params: SpectralParams | dict | None = None) -> Graph | Factored:
    p = params_of(SpectralParams, params)
    weights = spectral_pattern_weights(samples, p.instance_weight_gamma) if p.instance_weight_gamma > 0 else None
    loop = 1.0 if p.label_self_loops else 0.0
    if p.label_knn > 0 and samples.count() > p.label_knn:
        nodes = samples.select(F.col("id").alias("node"), F.lit(1).alias("n"), F.lit(loop).alias("own"))
        return Graph(nodes, knn_edges(samples, p.label_sim, p.label_knn), value_sums(samples, F.col("id"), weights))
    pats, stats = pattern_counts(samples), value_sums(samples, F.col("pattern"), weights)
    if p.label_sim in ("cosine", "hamming"):
        positive = F.exists("labels", lambda y: y > 0) if p.label_sim == "cosine" else F.lit(True)
        return Factored(pats.select(F.col("pattern").alias("node"), "n", (F.lit(loop) - F.when(positive, 1.0).otherwise(0.0)).alias("own"), factors(F.col("labels"), p.label_sim).alias("factors")), stats)
    edges = pattern_edges(pats, p.label_sim)
    itself = edges.where("p = q").select(F.col("p").alias("pattern"), F.col("w").alias("self"))
    nodes = pats.join(itself, "pattern", "left").select(F.col("pattern").alias("node"), "n", (F.lit(loop) - F.coalesce("self", F.lit(0.0))).alias("own"))
    return Graph(nodes, edges, stats)


def label_lists(patterns: DataFrame) -> DataFrame:
    """(pattern, n, c, held, lid, at): each pattern once per positive label; held: its labels, the one that fewest patterns have first; at: the place of ``lid``."""
    long = patterns.select("pattern", "n", F.posexplode("labels").alias("lid", "y")).where("y > 0").drop("y")
    many = long.groupBy("lid").agg(F.count("*").alias("many"))
    held = long.join(many, "lid").groupBy("pattern", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("many", "lid"))), lambda s: s["lid"]).alias("held"))
    return held.select("pattern", "n", F.size("held").alias("c"), "held", F.posexplode("held").alias("at", "lid"))


def _met(probes: DataFrame, lists: DataFrame, sim: str) -> DataFrame:
    """(p, q, n, w): patterns that meet on a label of ``probes`` (p, cp, held_p, lid, at_p, least), once each: on the first label of p that both have.

    Of two patterns that first meet at places i and j, what they share is at most least(cp - i, cq - j); a pair that so can't reach ``least``
    is never made, nor one whose sizes are too different for it.
    """
    low = F.col("least") - 1e-9
    cp, cq = F.col("cp"), F.col("cq")
    need = {"jaccard": low / (1 + low) * (cp + cq), "cosine": low * F.sqrt(cp * cq)}[sim]
    of = lists.select(F.col("pattern").alias("q"), F.col("c").alias("cq"), F.col("held").alias("held_q"), "lid", F.col("at").alias("at_q"), "n")
    room = F.least(cp - F.col("at_p"), cq - F.col("at_q"))
    met = probes.join(of, "lid").where((room >= need) & (F.least(cp, cq) >= need))
    common = F.array_intersect("held_p", "held_q")
    both = F.size("common")
    w = both / (cp + cq - both) if sim == "jaccard" else both / F.sqrt(cp * cq)
    return met.withColumn("common", common).where(F.get("common", F.lit(0)) == F.col("lid")).select("p", "q", "n", w.cast("double").alias("w"))


def near_patterns(patterns: DataFrame, sim: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of patterns (pattern, n, labels): the pairs (p, q, n, w) that may be among the k rows nearest to a row of p, and before it what they come from.

    Top-k join of sets by inverted lists in order of rarity, for Jaccard and cosine. Seeds: each pattern meets those that have its rarest label. The k-th
    best row there is a bound that all nearest rows reach, ties included (0 where the seeds hold fewer rows). Then p looks its labels up, rarest first, only as
    far as a pattern that shares none of them before could still reach the bound. Returns (pairs, seeds, bounds (p, least)).
    """
    lists = label_lists(patterns)
    probe = lists.select(F.col("pattern").alias("p"), F.col("c").alias("cp"), F.col("held").alias("held_p"), "lid", F.col("at").alias("at_p"))
    seeds = _met(probe.where("at_p = 0").withColumn("least", F.lit(0.0)), lists, sim)
    best = seeds.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("w"), "q"))).where(F.col("r") <= k)
    held = best.withColumn("rows", F.sum("n").over(Window.partitionBy("p").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = held.groupBy("p").agg(F.coalesce(F.max(F.when(F.col("rows") >= k, F.col("w"))), F.lit(0.0)).alias("least"))
    share = F.col("least") if sim == "jaccard" else F.col("least") * F.col("least")
    ahead = probe.join(bounds, "p").where(F.col("at_p") <= F.col("cp") - F.ceil(share * F.col("cp") - 1e-9))
    return _met(ahead, lists, sim), seeds, bounds


def knn_edges(samples: DataFrame, sim: str, k: int) -> DataFrame:
    """(p, q, w): each row with its k nearest rows by affinity (ties to the smaller id), made symmetric.

    The rows nearest to a pattern are among the k + 1 smallest ids of each of its k + 1 nearest patterns (ties to the smaller least id), so rows never meet
    all rows. For Jaccard and cosine ``near_patterns`` finds these patterns; Hamming affinities are above zero without a common label, so there
    patterns meet as in ``pattern_edges``. Neighbours of affinity zero are no edges.
    """
    rows = samples.select("id", pattern(F.col("labels")).alias("pattern"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("pattern").alias("q"), F.col("id").alias("near"))
    pats = samples.groupBy(pattern(F.col("labels")).alias("pattern")).agg(F.count("*").alias("n"), F.first("labels").alias("labels"), F.min("id").alias("low"))
    pairs = pattern_edges(pats, sim) if sim == "hamming" else near_patterns(pats, sim, k + 1)[0].select("p", "q", "w")
    by = Window.partitionBy("p").orderBy(F.desc("w"), "low")
    few = pairs.join(pats.select(F.col("pattern").alias("q"), "low"), "q").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select("p", "q", "w")
    best = few.join(first, "q").withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("w"), "near"))).where(F.col("r") <= k + 1).select(F.col("p").alias("pattern"), "near", "w", "r")
    own = rows.join(best, "pattern").where("id <> near").withColumn("own", F.row_number().over(Window.partitionBy("id").orderBy("r"))).where(F.col("own") <= k)
    directed = own.select(F.col("id").alias("p"), F.col("near").alias("q"), "w")
    return directed.union(directed.select("q", "p", "w")).groupBy("p", "q").agg(F.max("w").alias("w"))


def min_max_over(v: Column) -> Column:
    """A column of one row per feature, scaled to [0, 1]; 0.5 where it is constant."""
    low, high = F.min(v).over(Window.partitionBy()), F.max(v).over(Window.partitionBy())
    return F.when(high - low < EPS, 0.5).otherwise((v - low) / (high - low))


def blend(scores: DataFrame, alpha: float) -> DataFrame:
    """(fid, score, dirichlet, hsic): smoothness and alignment, each scaled, by alpha."""
    return scores.select("fid", ((1 - alpha) * (1 - min_max_over(F.col("dirichlet"))) + alpha * min_max_over(F.col("hsic"))).alias("score"), "dirichlet", "hsic")


def spectral_scores(samples: DataFrame, params: SpectralParams | dict | None = None) -> DataFrame:
    p = params_of(SpectralParams, params)
    return blend(label_graph(samples, p).scores(), p.alpha)


def fit_spectral(samples: DataFrame, params: SpectralParams | dict | None = None) -> tuple[DataFrame, dict]:
    """The ranking (rank, fid, score; fid from 1) and a dict of what it rests on."""
    from rankweave.operators.fusion import ranking

    p = params_of(SpectralParams, params)
    scores = spectral_scores(samples, p)
    facts = scores.agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"), F.avg("dirichlet").alias("dirichlet_mean"), F.avg("hsic").alias("hsic_mean")).first()
    return ranking(scores), {"alpha": p.alpha, "label_sim": p.label_sim, **facts.asDict()}
