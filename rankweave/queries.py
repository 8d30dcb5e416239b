"""The queries of the ranking operators over the driver tables, and the SQL that gives the same rows.

The SQL is written from the definitions, over pairs of rows where the operators use label patterns or blocks, so that it tests them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import columns as C
from rankweave.operators import evaluate, fusion, mlknn, solver, spectral, weights
from rankweave.operators.knn import knn
from rankweave.operators.sparse import sparse
from rankweave.plans.params import VARIANTS, EmbeddedParams, MlknnParams, SelectionParams, SpectralParams
from rankweave.plans.pipeline import rank_features
from rankweave.sources import samples as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GRID = SelectionParams().grid
K = 10


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(name or c)


def q6(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- inputs as SQL

VECTORS = """f AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS features,
  list_concat(list_transform(range(10), lambda i: CAST(label = i AS INTEGER)), [CAST(label % 2 AS INTEGER), CAST(label >= 5 AS INTEGER)]) AS labels FROM embeddings)"""


def _scaled_sql(raw: str, n: int) -> str:
    one = ", ".join(f"CASE WHEN max(f{i}) OVER () > min(f{i}) OVER () THEN (f{i} - min(f{i}) OVER ()) / (max(f{i}) OVER () - min(f{i}) OVER ()) ELSE 0.0 END" for i in range(n))
    return f"g AS ({raw}), f AS (SELECT id, [{one}] AS features, labels FROM g)"


def _any(test: str) -> str:
    return f"max(CAST({test} AS INTEGER))"


_LABELS = ", ".join([_any(f"l_returnflag = '{v}'") for v in "ANR"] + [_any(f"l_linestatus = '{v}'") for v in "OF"])
BASKETS = _scaled_sql(
    "SELECT l_orderkey AS id, sum(l_quantity) f0, avg(l_quantity) f1, min(l_quantity) f2, max(l_quantity) f3, sum(l_extendedprice) f4, avg(l_extendedprice) f5,"
    f" avg(l_discount) f6, max(l_discount) f7, avg(l_tax) f8, CAST(count(*) AS DOUBLE) f9, [{_LABELS}] AS labels FROM lineitem GROUP BY l_orderkey", 10,
)
_KINDS = ["' '", "'0123456789'", "chr(10)", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'.,;:!?'"]
TEXTS = _scaled_sql(
    "SELECT doc_id AS id, CAST(n_chars AS DOUBLE) f0, " + ", ".join(f"CAST(length(text) - length(translate(text, {k}, '')) AS DOUBLE) f{i + 1}" for i, k in enumerate(_KINDS))
    + ", [CAST(quality > 0 AS INTEGER), CAST(toxic > 0 AS INTEGER)] AS labels FROM labels JOIN documents USING (doc_id)", 6,
)
LONG = """x AS (SELECT id, CAST(unnest(range(len(features))) AS INTEGER) AS fid, unnest(features) AS val FROM f),
y AS (SELECT id, CAST(unnest(range(len(labels))) AS INTEGER) AS lid, unnest(labels) AS y FROM f)"""
FREQ = "fr AS (SELECT lid, CAST(sum(y) + 1 AS DOUBLE) AS freq FROM y GROUP BY lid)"
PRIOR = "pr AS (SELECT lid, freq, pow(freq, -2.0) / (sum(pow(freq, -2.0)) OVER () + 1e-12) AS prior FROM fr)"
WEIGHTS = """raw AS (SELECT id, least(1 + 1.5 * sum(y.y * prior), 3.0) AS raw FROM y JOIN pr USING (lid) GROUP BY id),
wt AS (SELECT id, raw / (avg(raw) OVER () + 1e-12) AS s FROM raw)"""
TAIL = "tw AS (SELECT lid, pow(freq, -0.5) / (avg(pow(freq, -0.5)) OVER () + 1e-12) AS weight FROM fr)"


def over(*parts: str, then: str) -> str:
    return f"WITH {', '.join(parts)} {then}"


# ---- labels and weights


@query(over(VECTORS, then="SELECT id, array_to_string(labels, '') AS pattern FROM f"))
def label_binarize(spark, d):
    both_signs = S.vectors(spark, d).withColumn("labels", F.transform("labels", lambda v: 2 * v.cast("int") - 1))
    return both_signs.select("id", C.pattern(C.binarized(F.col("labels"))).alias("pattern"))


@query(over(BASKETS, LONG, FREQ, then="SELECT lid, freq FROM fr"))
def label_freq(spark, d):
    return weights.label_freq(S.order_baskets(spark, d))


@query(over(BASKETS, LONG, FREQ, PRIOR, then=f"SELECT lid, freq, {q6('prior')} FROM pr"))
def rarity_prior(spark, d):
    return weights.rarity_prior(S.order_baskets(spark, d)).select("lid", "freq", r6("prior"))


@query(over(BASKETS, LONG, FREQ, PRIOR, WEIGHTS, then=f"SELECT id, {q6('s')}, {q6('sqrt(s)', 'sw')} FROM wt"))
def instance_weights(spark, d):
    return weights.instance_weights(S.order_baskets(spark, d)).select("id", r6("s"), r6("sw"))


@query(over(BASKETS, LONG, FREQ, TAIL, then=f"SELECT lid, {q6('weight')} FROM tw"))
def tail_weights(spark, d):
    return weights.tail_weights(S.order_baskets(spark, d), 1.0).select("lid", r6("weight"))


@query(over(BASKETS, then="SELECT array_to_string(labels, '') AS pattern, count(*) AS n FROM f GROUP BY 1"))
def label_pattern_counts(spark, d):
    return weights.pattern_counts(S.order_baskets(spark, d)).select("pattern", "n")


@query(over(BASKETS, LONG, then="SELECT a.lid AS l1, b.lid AS l2, count(*) AS n FROM y a JOIN y b ON a.id = b.id AND a.y > 0 AND b.y > 0 GROUP BY 1, 2"))
def label_gram(spark, d):
    return weights.label_gram(S.order_baskets(spark, d))


@query(over(VECTORS, LONG, FREQ, TAIL, then=f"SELECT id, lid, {q6('weight', 'value')} FROM y JOIN tw USING (lid) WHERE y.y > 0"))
def weighted_labels(spark, d):
    return weights.weighted_labels(S.vectors(spark, d), 1.0).select("id", "lid", r6("value"))


@query(over(TEXTS, LONG, FREQ, PRIOR, WEIGHTS, then=f"SELECT id, fid, {q6('val * sqrt(s)', 'val')} FROM x JOIN wt USING (id)"))
def row_scale(spark, d):
    rows = S.text_rows(spark, d)
    w = weights.instance_weights(rows)
    return S.feature_values(rows.join(w, "id").withColumn("features", C.scaled(F.col("features"), F.col("sw")))).select("id", "fid", r6("val"))


@query(over(VECTORS, LONG, then=f"SELECT id, fid, {q6('val / greatest(sqrt(list_dot_product(features, features)), 1e-12)', 'val')} FROM x JOIN f USING (id)"))
def unit_norm(spark, d):
    return S.feature_values(S.vectors(spark, d).withColumn("features", C.unit(F.col("features")))).select("id", "fid", r6("val"))


@query(over(BASKETS, LONG, then=f"SELECT id, fid, {q6('val')} FROM x"))
def minmax_features(spark, d):
    return S.feature_values(S.order_baskets(spark, d)).select("id", "fid", r6("val"))


# ---- label-affinity graph

_YD = "p AS (SELECT DISTINCT array_to_string(labels, '') AS pattern, list_transform(labels, lambda v: CAST(v AS DOUBLE)) AS y FROM f)"


def affinity(sim: str, a: str, b: str) -> str:
    both, ca, cb = f"list_dot_product({a}.y, {b}.y)", f"list_sum({a}.y)", f"list_sum({b}.y)"
    return {
        "jaccard": f"{both} / greatest({ca} + {cb} - {both}, 1e-10)",
        "cosine": f"{both} / (greatest(sqrt({ca}), 1e-10) * greatest(sqrt({cb}), 1e-10))",
        "hamming": f"(len({a}.y) - {ca} - {cb} + 2 * {both}) / len({a}.y)",
    }[sim]


def _affinity(sim: str) -> None:
    def run(spark, d):
        return spectral.pattern_edges(weights.pattern_counts(S.order_baskets(spark, d)), sim).select("p", "q", r6("w"))

    run.__name__ = f"affinity_{sim}"
    query(over(BASKETS, _YD, f"e AS (SELECT a.pattern AS p, b.pattern AS q, {affinity(sim, 'a', 'b')} AS w FROM p a, p b)", then=f"SELECT p, q, {q6('w')} FROM e WHERE w > 0"))(run)


for _sim in ("jaccard", "cosine", "hamming"):
    _affinity(_sim)


def graph_sql(sim: str = "jaccard", alpha: float = 0.5, loop: float = 0.0, gamma: float = 0.0, k: int = 0) -> tuple[str, ...]:
    """Rows against rows of the vectors."""
    pairs = f"SELECT a.id AS i, b.id AS j, {affinity(sim, 'a', 'b')} AS w FROM n a, n b WHERE a.id <> b.id"
    if k:
        pairs = f"SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM top UNION ALL SELECT j, i, w FROM top) GROUP BY i, j"
    pre = (f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM (SELECT a.id AS i, b.id AS j, {affinity(sim, 'a', 'b')} AS w FROM n a, n b WHERE a.id <> b.id)) WHERE r <= {k} AND w > 0)",) if k else ()
    x = "xw AS (SELECT id, fid, val FROM x)"
    if gamma:
        x = f"""lf AS (SELECT lid, avg(y) AS freq FROM y GROUP BY lid), iw AS (SELECT id, pow(sum(y.y / greatest(freq, 1e-10)), {gamma}) AS w FROM y JOIN lf USING (lid) GROUP BY id),
        xw AS (SELECT id, fid, val * w / (SELECT avg(w) FROM iw) AS val FROM x JOIN iw USING (id))"""
    return (
        VECTORS, LONG, "n AS (SELECT id, list_transform(labels, lambda v: CAST(v AS DOUBLE)) AS y FROM f)", *pre,
        f"a AS ({pairs} UNION ALL SELECT id, id, {loop} FROM n)", x,
        "dg AS (SELECT i, sum(w) AS deg, CASE WHEN sum(w) > 1e-10 THEN 1 / sqrt(sum(w)) ELSE 0 END AS d FROM a GROUP BY i)",
        "ax AS (SELECT a.i, fid, sum(w * val) AS ws, sum(w * d * val) AS wds FROM a JOIN xw ON xw.id = a.j JOIN dg ON dg.i = a.j GROUP BY a.i, fid)",
        "qd AS (SELECT xw.fid, sum(val * val) AS xx, sum(val * ws) AS xax, sum(d * val * wds) AS xnx, sum(deg * val) AS deg_x, sum(val) AS sum_x FROM xw JOIN ax ON ax.i = xw.id AND ax.fid = xw.fid JOIN dg ON dg.i = xw.id GROUP BY xw.fid)",
        "tt AS (SELECT count(*) AS n, sum(deg) AS mass FROM dg)",
        "sc AS (SELECT fid, (xx - xnx) / (xx + 1e-10) AS dirichlet, (xax - 2 * sum_x * deg_x / n + mass / (n * n) * sum_x * sum_x) / (xx + 1e-10) AS hsic FROM qd, tt)",
        f"""bl AS (SELECT fid, dirichlet, hsic, (1 - {alpha}) * (1 - CASE WHEN max(dirichlet) OVER () - min(dirichlet) OVER () < 1e-10 THEN 0.5 ELSE (dirichlet - min(dirichlet) OVER ()) / (max(dirichlet) OVER () - min(dirichlet) OVER ()) END)
        + {alpha} * CASE WHEN max(hsic) OVER () - min(hsic) OVER () < 1e-10 THEN 0.5 ELSE (hsic - min(hsic) OVER ()) / (max(hsic) OVER () - min(hsic) OVER ()) END AS score FROM sc)""",
    )


@query(over(*graph_sql(k=K)[:5], then=f"SELECT i AS p, j AS q, {q6('w')} FROM a WHERE i <> j"))
def affinity_knn_sym(spark, d):
    return spectral.knn_edges(S.vectors(spark, d), "jaccard", K).select("p", "q", r6("w"))


@query(over(*graph_sql()[:6], then=f"SELECT array_to_string(labels, '') AS pattern, {q6('avg(deg)', 'deg')} FROM dg JOIN f ON f.id = dg.i GROUP BY 1"))
def graph_degree(spark, d):
    return spectral.label_graph(S.vectors(spark, d)).degrees().select(F.col("node").alias("pattern"), r6("deg"))


@query(over(*graph_sql()[:6], then=f"SELECT DISTINCT array_to_string(f.labels, '') AS p, array_to_string(g.labels, '') AS q, {q6('w * s.d * t.d', 'w')} FROM a JOIN dg s ON s.i = a.i JOIN dg t ON t.i = a.j JOIN f ON f.id = a.i JOIN f g ON g.id = a.j WHERE a.i <> a.j AND w > 0"))
def laplacian_edges(spark, d):
    g = spectral.label_graph(S.vectors(spark, d))
    deg = g.degrees()
    edges = g.edges.join(deg.select(F.col("node").alias("p"), F.col("d").alias("dp"), F.col("n").alias("np")), "p").join(deg.select(F.col("node").alias("q"), F.col("d").alias("dq")), "q")
    return edges.where("p <> q or np > 1").select("p", "q", r6(F.col("w") * F.col("dp") * F.col("dq"), "w"))


@query(over(*graph_sql()[:6], then=f"SELECT array_to_string(labels, '') AS pattern, {q6('avg(deg) / (SELECT count(*) FROM f)', 'row_mean')}, {q6('(SELECT sum(deg) FROM dg) / pow((SELECT count(*) FROM f), 2)', 'total_mean')} FROM dg JOIN f ON f.id = dg.i GROUP BY 1"))
def kernel_centering(spark, d):
    deg = spectral.label_graph(S.vectors(spark, d)).degrees()
    total = deg.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("deg")).alias("mass"))
    n = F.col("rows")
    return weights.beside(deg, total).select(F.col("node").alias("pattern"), r6(F.col("deg") / n, "row_mean"), r6(F.col("mass") / (n * n), "total_mean"))


@query(over(BASKETS, LONG, then=f"SELECT fid, {q6('sum(val * val)', 'xx')} FROM x GROUP BY fid"))
def feature_quadratic(spark, d):
    return spectral.value_sums(S.order_baskets(spark, d), C.pattern(F.col("labels"))).groupBy("fid").agg(r6(F.sum("q"), "xx"))


@query(over(TEXTS, LONG, then=f"SELECT a.fid AS f1, b.fid AS f2, {q6('sum(a.val * b.val)', 'g')} FROM x a JOIN x b USING (id) GROUP BY 1, 2"))
def feature_gram(spark, d):
    rows = S.text_rows(spark, d)
    n, size, _ = S.sizes(rows)
    g = solver.gram(rows.select("features", "labels", F.lit(1.0).alias("s")), size)
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(size) for j in range(size)], "f1 int, f2 int, g double").select("f1", "f2", r6("g"))


@query(over(*graph_sql(), then=f"SELECT fid, {q6('dirichlet')} FROM sc"))
def dirichlet_energy(spark, d):
    return spectral.label_graph(S.vectors(spark, d)).scores().select("fid", r6("dirichlet"))


@query(over(*graph_sql(), then=f"SELECT fid, {q6('hsic')} FROM sc"))
def hsic_score(spark, d):
    return spectral.label_graph(S.vectors(spark, d)).scores().select("fid", r6("hsic"))


@query(over(VECTORS, LONG, "lf AS (SELECT lid, avg(y) AS freq FROM y GROUP BY lid)", "iw AS (SELECT id, pow(sum(y.y / greatest(freq, 1e-10)), 0.5) AS w FROM y JOIN lf USING (lid) GROUP BY id)", then=f"SELECT id, {q6('w / avg(w) OVER ()', 'w')} FROM iw"))
def spectral_instance_weight(spark, d):
    rows = S.vectors(spark, d)
    return rows.select("id", C.pattern(F.col("labels")).alias("pattern")).join(weights.spectral_pattern_weights(rows, 0.5), "pattern").select("id", r6("w"))


def _spectral(name: str, given: dict, **sql) -> None:
    def run(spark, d):
        return spectral.spectral_scores(S.vectors(spark, d), SpectralParams(**given)).select("fid", r6("score"))

    run.__name__ = f"spectral_scores_{name}"
    query(over(*graph_sql(**sql), then=f"SELECT fid, {q6('score')} FROM bl"))(run)


_spectral("jaccard", {})
_spectral("cosine", {"label_sim": "cosine", "alpha": 0.7}, sim="cosine", alpha=0.7)
_spectral("hamming", {"label_sim": "hamming"}, sim="hamming")
_spectral("selfloops", {"label_self_loops": True}, loop=1.0)
_spectral("weighted", {"instance_weight_gamma": 0.5}, gamma=0.5)
_spectral("knn", {"label_knn": K}, k=K)


_FACTS = {"score_min": "min(score)", "score_max": "max(score)", "score_mean": "avg(score)", "dirichlet_mean": "avg(dirichlet)", "hsic_mean": "avg(hsic)"}


@query(over(*graph_sql(alpha=0.7), then=f"SELECT {', '.join(q6(v, k) for k, v in _FACTS.items())} FROM bl"))
def spectral_facts(spark, d):
    facts = spectral.fit_spectral(S.vectors(spark, d), {"alpha": 0.7})[1]
    return spark.createDataFrame([tuple(facts[k] for k in _FACTS)], ", ".join(f"{k} double" for k in _FACTS)).select(*(r6(k) for k in _FACTS))


@query(over(*graph_sql(alpha=0.7), then=f"SELECT CAST(row_number() OVER (ORDER BY score DESC, fid) AS INTEGER) AS rank, fid + 1 AS fid, {q6('score')} FROM bl"))
def spectral_ranking(spark, d):
    return spectral.fit_spectral(S.vectors(spark, d), {"alpha": 0.7})[0].select("rank", "fid", r6("score"))


def basket_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: features of orders, ranked."""
    return spectral.fit_spectral(S.order_baskets(spark, d))[0].select("rank", "fid", r6("score"))


_PAT = """ps AS (SELECT array_to_string(labels, '') AS p, count(*) AS n, any_value(list_transform(labels, lambda v: CAST(v AS DOUBLE))) AS y FROM f GROUP BY 1),
st AS (SELECT array_to_string(labels, '') AS p, fid, sum(val) AS s, sum(val * val) AS q FROM f JOIN x USING (id) GROUP BY 1, 2),
ed AS (SELECT a.p, b.p AS q, b.n, {w} AS w FROM ps a, ps b),
own AS (SELECT p, -w AS own FROM ed WHERE p = q),
dg AS (SELECT p, sum(n * w) + any_value(own) AS deg FROM ed JOIN own USING (p) GROUP BY p),
dd AS (SELECT p, own, deg, CASE WHEN deg > 1e-10 THEN 1 / sqrt(deg) ELSE 0 END AS d FROM dg JOIN own USING (p)),
ax AS (SELECT ed.p, fid, sum(w * s) AS ws, sum(w * d * s) AS wds FROM ed JOIN st ON st.p = ed.q JOIN dd ON dd.p = ed.q GROUP BY 1, 2),
qd AS (SELECT fid, sum(q) AS xx, sum(s * ws + own * q) AS xax, sum(d * s * wds + d * d * own * q) AS xnx, sum(deg * s) AS deg_x, sum(s) AS sum_x FROM st JOIN ax USING (p, fid) JOIN dd USING (p) GROUP BY fid),
tt AS (SELECT sum(n) AS n, sum(n * deg) AS mass FROM ps JOIN dd USING (p))""".format(w=affinity("jaccard", "a", "b"))
query(over(BASKETS, LONG, _PAT, *graph_sql()[-2:], then=f"SELECT CAST(row_number() OVER (ORDER BY score DESC, fid) AS INTEGER) AS rank, fid + 1 AS fid, {q6('score')} FROM bl"))(basket_ranking)


# ---- fusion: the energies of the orders' features stand for the two sources

_TWO = "ev AS (SELECT fid, sum(val * val) AS e, avg(val) AS s FROM x GROUP BY fid)"


def _rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 0.5) / count(*) OVER ()"


_RANKED = f"rk AS (SELECT fid, {_rank_sql('e')} AS e, {_rank_sql('s')} AS s FROM ev)"
_GRIDDED = f"gr AS (SELECT mu_e, mu_s, fid, CASE WHEN e >= s THEN s + (e - s) * mu_e ELSE e + (s - e) * mu_s END AS score FROM rk, (SELECT unnest({list(GRID)}::DOUBLE[]) AS mu_e), (SELECT unnest({list(GRID)}::DOUBLE[]) AS mu_s))"


def _sources(spark, d) -> tuple[DataFrame, DataFrame]:
    x = S.feature_values(S.order_baskets(spark, d)).groupBy("fid").agg(F.sum(F.col("val") * F.col("val")).alias("e"), F.avg("val").alias("s"))
    return fusion.rank_uniform(x.select("fid", F.col("e").alias("score"))), fusion.rank_uniform(x.select("fid", F.col("s").alias("score")))


@query(over(BASKETS, LONG, _TWO, _RANKED, then=f"SELECT fid, {q6('e')}, {q6('s')} FROM rk"))
def rank_uniform(spark, d):
    e, s = _sources(spark, d)
    return e.withColumnRenamed("score", "e").join(s.withColumnRenamed("score", "s"), "fid").select("fid", r6("e"), r6("s"))


@query(over(BASKETS, LONG, _TWO, _RANKED, then=f"SELECT fid, {q6('CASE WHEN e >= s THEN s + (e - s) * 0.8 ELSE e + (s - e) * 0.6 END', 'score')} FROM rk"))
def choquet_fuse(spark, d):
    return fusion.fuse(*_sources(spark, d), 0.8, 0.6).select("fid", r6("score"))


@query(over(BASKETS, LONG, _TWO, _RANKED, _GRIDDED, then=f"SELECT mu_e, mu_s, fid, {q6('score')} FROM gr"))
def choquet_grid(spark, d):
    return fusion.fuse_grid(*_sources(spark, d), GRID).select("mu_e", "mu_s", "fid", r6("score"))


@query(over(BASKETS, LONG, _TWO, _RANKED, _GRIDDED, then=f"SELECT DISTINCT mu_e, mu_s, {q6('1 - mu_e - mu_s', 'interaction')} FROM gr"))
def interaction_index(spark, d):
    return fusion.fuse_grid(*_sources(spark, d), GRID).select("mu_e", "mu_s").distinct().select("mu_e", "mu_s", r6(C.interaction(F.col("mu_e"), F.col("mu_s")), "interaction"))


_FUSED = "fu AS (SELECT fid, CASE WHEN e >= s THEN s + (e - s) * 0.8 ELSE e + (s - e) * 0.6 END AS score FROM rk)"


@query(over(BASKETS, LONG, _TWO, _RANKED, _FUSED, then=f"SELECT fid, {q6('score')} FROM fu ORDER BY fu.score DESC, fid LIMIT 2"))
def topk_features(spark, d):
    e, s = _sources(spark, d)
    return fusion.top_features(fusion.fuse(e, s, 0.8, 0.6), fusion.n_selected(10, 0.2)).select("fid", r6("score"))


@query(over(BASKETS, LONG, _TWO, _RANKED, _FUSED, then=f"SELECT CAST(row_number() OVER (ORDER BY fu.score DESC, fid) AS INTEGER) AS rank, fid + 1 AS fid, {q6('score')} FROM fu"))
def final_ranking(spark, d):
    return fusion.ranking(fusion.fuse(*_sources(spark, d), 0.8, 0.6)).select("rank", "fid", r6("score"))


@query(over(BASKETS, LONG, _TWO, _RANKED, _GRIDDED, "gm AS (SELECT mu_e, mu_s, round(avg(score), 10) AS gm FROM gr GROUP BY 1, 2)", then=f"SELECT mu_e, mu_s, {q6('gm')} FROM gm ORDER BY gm.gm DESC, mu_e, mu_s LIMIT 1"))
def capacity_argmax(spark, d):
    means = fusion.fuse_grid(*_sources(spark, d), GRID).groupBy("mu_e", "mu_s").agg(F.round(F.avg("score"), 10).alias("gm"))
    return fusion.best_capacities(means).select("mu_e", "mu_s", r6("gm"))


# ---- neighbours and classifiers

FOLD = "fd AS (SELECT id, CAST((row_number() OVER (ORDER BY md5(concat('42:', id)), id) - 1) % 3 AS INTEGER) AS fold FROM f)"
UNIT = "u AS (SELECT id, labels, list_transform(features, lambda v: v / greatest(sqrt(list_dot_product(features, features)), 1e-12)) AS v FROM f)"
NEAR = f"""nn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, near) AS INTEGER) AS rank FROM
  (SELECT a.id, b.id AS near, round(list_dot_product(a.v, b.v), 10) AS sim FROM u a, u b WHERE a.id <> b.id)) WHERE rank <= {K})"""
NEAR_FOLD = f"""nn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fold, id ORDER BY sim DESC, near) AS INTEGER) AS rank FROM
  (SELECT t.fold, a.id, b.id AS near, round(list_dot_product(a.v, b.v), 10) AS sim FROM (SELECT DISTINCT fold FROM fd) t, u a, u b JOIN fd ON fd.id = b.id WHERE a.id <> b.id AND fd.fold <> t.fold)) WHERE rank <= {K})"""


def _grouped(spark, d) -> DataFrame:
    return S.vectors(spark, d).select(F.lit("").alias("grp"), "id", "features", "labels", F.lit(True).alias("train"))


@query(over(VECTORS, FOLD, then="SELECT id, fold FROM fd"))
def kfold_assign(spark, d):
    return evaluate.folds(S.vectors(spark, d))


@query(over(VECTORS, UNIT, NEAR, then=f"SELECT id, near, {q6('sim')}, rank FROM nn"))
def knn_cosine_fit(spark, d):
    return mlknn.neighbours(_grouped(spark, d), K).select("id", "near", r6("sim"), "rank")


@query(over(VECTORS, UNIT, NEAR, then=f"SELECT id, near, {q6('sim')}, rank FROM nn"))
def knn_cosine_fit_sparse(spark, d):
    return mlknn.neighbours(_grouped(spark, d).withColumn("features", sparse(F.col("features"))), K).select("id", "near", r6("sim"), "rank")


@query(over(VECTORS, UNIT, FOLD, NEAR_FOLD, then=f"SELECT id, near, {q6('sim')}, rank FROM nn JOIN fd USING (id) WHERE nn.fold = 0 AND fd.fold = 0"))
def knn_cosine_predict(spark, d):
    rows = S.vectors(spark, d)
    dealt = rows.join(evaluate.folds(rows), "id").select(F.lit("").alias("grp"), "id", "features", "fold")
    return knn(dealt.where("fold = 0").drop("fold"), dealt.where("fold <> 0").drop("fold"), K).select("id", "near", r6("sim"), "rank")


COUNTS = "ct AS (SELECT nn.id, lid, CAST(sum(y.y) AS INTEGER) AS c FROM nn JOIN y ON y.id = nn.near GROUP BY 1, 2)"
PRIORS = "mp AS (SELECT lid, sum(y) AS pos, count(*) AS n, (1 + sum(y)) / (2.0 + count(*)) AS p1 FROM y GROUP BY lid)"
CONDS = f"""hs AS (SELECT lid, c, sum(y.y) AS t, sum(1 - y.y) AS f FROM ct JOIN y USING (id, lid) GROUP BY 1, 2),
mc AS (SELECT lid, k.c, (1 + coalesce(t, 0)) / ({K + 1}.0 + pos) AS p1, (1 + coalesce(hs.f, 0)) / ({K + 1}.0 + n - pos) AS p0 FROM mp CROSS JOIN (SELECT CAST(unnest(range({K + 1})) AS INTEGER) AS c) k LEFT JOIN hs USING (lid, c))"""
PROBA = "pb AS (SELECT id, lid, CASE WHEN mp.p1 * mc.p1 + (1 - mp.p1) * mc.p0 = 0 THEN 0.5 ELSE mp.p1 * mc.p1 / (mp.p1 * mc.p1 + (1 - mp.p1) * mc.p0) END AS proba FROM ct JOIN mc USING (lid, c) JOIN mp USING (lid))"


@query(over(VECTORS, LONG, UNIT, NEAR, COUNTS, then="SELECT id, lid, c FROM ct"))
def neighbor_label_counts(spark, d):
    rows = _grouped(spark, d)
    return mlknn.neighbour_counts(mlknn.neighbours(rows, K), rows.select("id", "labels")).select("id", "lid", "c")


def _fitted(spark, d, **given) -> mlknn.Mlknn:
    return mlknn.Mlknn(MlknnParams(k=K, **given)).fit(S.vectors(spark, d))


@query(over(VECTORS, LONG, PRIORS, then=f"SELECT lid, {q6('p1')}, {q6('1 - p1', 'p0')} FROM mp"))
def mlknn_prior(spark, d):
    return _fitted(spark, d).model.prior.select("lid", r6("p1"), r6("p0"))


@query(over(VECTORS, LONG, UNIT, NEAR, COUNTS, PRIORS, CONDS, then=f"SELECT lid, c, {q6('p1')}, {q6('p0')} FROM mc"))
def mlknn_conditional(spark, d):
    return _fitted(spark, d).model.cond.select("lid", "c", r6("p1"), r6("p0"))


@query(over(VECTORS, LONG, UNIT, NEAR, COUNTS, PRIORS, CONDS, PROBA, then=f"SELECT id, lid, {q6('proba')} FROM pb"))
def mlknn_proba(spark, d):
    return _fitted(spark, d).predict_proba(S.vectors(spark, d)).select("id", "lid", r6("proba"))


LABEL_K = f"""lf AS (SELECT lid, avg(y) AS freq FROM y GROUP BY lid),
lk AS (SELECT lid, CAST(least(greatest(round_even({K} * pow(freq / greatest((SELECT median(freq) FROM lf WHERE freq > 0), 1e-6), 0.5), 0), 3), {K}) AS INTEGER) AS k FROM lf)"""
ADAPTIVE = """ct AS (SELECT nn.id, lid, CAST(sum(CASE WHEN rank <= k THEN y.y ELSE 0 END) AS INTEGER) AS c FROM nn JOIN y ON y.id = nn.near JOIN lk USING (lid) GROUP BY 1, 2),
hs AS (SELECT lid, c, sum(y.y) AS t, sum(1 - y.y) AS f FROM ct JOIN y USING (id, lid) GROUP BY 1, 2),
mc AS (SELECT lid, q.c, (1 + coalesce(t, 0)) / (k + 1.0 + pos) AS p1, (1 + coalesce(hs.f, 0)) / (k + 1.0 + n - pos) AS p0 FROM mp JOIN (SELECT lid, k, CAST(unnest(range(k + 1)) AS INTEGER) AS c FROM lk) q USING (lid) LEFT JOIN hs USING (lid, c))"""


@query(over(VECTORS, LONG, LABEL_K, then="SELECT lid, k FROM lk"))
def mlknn_label_k(spark, d):
    return mlknn.adaptive_k(mlknn.label_totals(_grouped(spark, d)), MlknnParams(k=K, label_adaptive_k=True)).select("lid", "k")


@query(over(VECTORS, LONG, UNIT, NEAR, LABEL_K, PRIORS, ADAPTIVE, PROBA, then=f"SELECT id, lid, {q6('proba')} FROM pb"))
def mlknn_proba_adaptive(spark, d):
    return _fitted(spark, d, label_adaptive_k=True).predict_proba(S.vectors(spark, d)).select("id", "lid", r6("proba"))


FOLDED = f"""ct AS (SELECT nn.fold, nn.id, lid, CAST(sum(y.y) AS INTEGER) AS c FROM nn JOIN y ON y.id = nn.near GROUP BY 1, 2, 3),
tr AS (SELECT t.fold, y.id, lid, y.y FROM (SELECT DISTINCT fold FROM fd) t, y JOIN fd ON fd.id = y.id WHERE fd.fold <> t.fold),
mp AS (SELECT fold, lid, sum(y) AS pos, count(*) AS n, (1 + sum(y)) / (2.0 + count(*)) AS p1 FROM tr GROUP BY 1, 2),
hs AS (SELECT fold, lid, c, sum(tr.y) AS t, sum(1 - tr.y) AS f FROM ct JOIN tr USING (fold, id, lid) GROUP BY 1, 2, 3),
mc AS (SELECT fold, lid, k.c, (1 + coalesce(t, 0)) / ({K + 1}.0 + pos) AS p1, (1 + coalesce(hs.f, 0)) / ({K + 1}.0 + n - pos) AS p0 FROM mp CROSS JOIN (SELECT CAST(unnest(range({K + 1})) AS INTEGER) AS c) k LEFT JOIN hs USING (fold, lid, c)),
pd AS (SELECT ct.fold, ct.id, lid, CAST(mp.p1 * mc.p1 >= 0.5 * (mp.p1 * mc.p1 + (1 - mp.p1) * mc.p0) AS INTEGER) AS pred, y.y FROM (SELECT ct.* FROM ct JOIN fd ON fd.id = ct.id AND fd.fold = ct.fold) ct JOIN mc USING (fold, lid, c) JOIN mp USING (fold, lid) JOIN y USING (id, lid))"""
MICRO = """mi AS (SELECT fold, 2 * (tp / greatest(p, 1e-12)) * (tp / greatest(t, 1e-12)) / greatest(tp / greatest(p, 1e-12) + tp / greatest(t, 1e-12), 1e-12) AS micro
  FROM (SELECT fold, CAST(sum(pred * y) AS DOUBLE) AS tp, sum(pred) AS p, sum(y) AS t FROM pd GROUP BY fold))"""
MACRO = "ma AS (SELECT fold, coalesce(avg(CASE WHEN b > 0 THEN 2.0 * tp / b END), 0) AS macro FROM (SELECT fold, lid, sum(pred * y) AS tp, sum(pred) + sum(y) AS b FROM pd GROUP BY 1, 2) GROUP BY fold)"
_CV = (VECTORS, LONG, UNIT, FOLD, NEAR_FOLD, FOLDED)


def _all_features(spark, d) -> tuple:
    return S.vectors(spark, d), spark.createDataFrame([("all", list(range(64)))], "subset string, selected array<int>"), MlknnParams(k=K), 3, 42


def _outcomes(spark, d) -> DataFrame:
    return evaluate.judged(*_all_features(spark, d)).outcomes


@query(over(*_CV, then="SELECT fold, id, lid, pred FROM pd"))
def threshold_predict(spark, d):
    return evaluate.fold_predictions(*_all_features(spark, d)).select("fold", "id", "lid", "pred")


@query(over(*_CV, MICRO, then=f"SELECT fold, {q6('micro')} FROM mi"))
def micro_f1(spark, d):
    return evaluate.micro_f1(_outcomes(spark, d), "fold").select("fold", r6("micro"))


@query(over(*_CV, MACRO, then=f"SELECT fold, {q6('macro')} FROM ma"))
def macro_f1(spark, d):
    return evaluate.macro_f1(_outcomes(spark, d), "fold").select("fold", r6("macro"))


@query(over(*_CV, MICRO, MACRO, then=f"SELECT 'all' AS subset, {q6('sqrt(avg(micro) * avg(macro))', 'gm')} FROM mi JOIN ma USING (fold)"))
def geometric_mean_f1(spark, d):
    rows = _outcomes(spark, d)
    return evaluate.geometric_mean(evaluate.micro_f1(rows, "subset", "fold"), evaluate.macro_f1(rows, "subset", "fold"), "subset").select("subset", r6("gm"))


# ---- the embedded solver


@query(over(VECTORS, LONG, then=f"SELECT id, fid, {q6('CASE WHEN 9 * val >= 0 THEN 1 / (1 + exp(-9 * val)) ELSE exp(9 * val) / (1 + exp(9 * val)) END', 'p')} FROM x"))
def sigmoid_col(spark, d):
    return S.feature_values(S.vectors(spark, d)).select("id", "fid", r6(C.sigmoid(9 * F.col("val")), "p"))


@query(over(VECTORS, LONG, then=f"SELECT id, fid, {q6('greatest(9 * val, 0) + ln(1 + exp(-abs(9 * val))) - 9 * val', 'loss')} FROM x"))
def logistic_loss_col(spark, d):
    return S.feature_values(S.vectors(spark, d)).select("id", "fid", r6(C.logistic_loss(9 * F.col("val"), F.lit(1.0)), "loss"))


_ALPHA, _STEP, _BETA = 0.35, 1e-4, 50.0
_GRAD = f"gz AS (SELECT fid, lid, sum(val * s * (-(1 - {_ALPHA}) * y.y / (1 + 1e-12) + {_ALPHA} * (0.5 - y.y))) AS g FROM x JOIN y USING (id) JOIN wt USING (id) GROUP BY 1, 2)"
_EMB = (TEXTS, LONG, FREQ, PRIOR, WEIGHTS)


def _at_zero(spark, d):
    """Sums at zero weights with each label as its own target, and the problem."""
    import numpy as np

    rows = S.text_rows(spark, d)
    p = EmbeddedParams(alpha=_ALPHA)
    n, size, n_labels = S.sizes(rows)
    _, lw = solver.embedding(rows, n_labels, 0.0, n, n_labels)
    of = solver.prepared(rows, p)
    problem = solver.Problem(p, np.eye(n_labels), lw, float(of.agg(F.sum("s")).first()[0]), _STEP, 0.0)
    zero = np.zeros((size, n_labels))
    out = solver.block_sums(of, solver.gradient_sums(problem, zero, np.zeros(n_labels), zero, np.zeros(n_labels)))
    return out[: size * n_labels].reshape(size, n_labels), out[-2:], problem, zero


def _matrix(spark, m, name: str) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], f"fid int, lid int, {name} double").select("fid", "lid", r6(name))


@query(over(*_EMB, then=f"SELECT {q6(f'(1 - {_ALPHA}) * 0.5 * sum(s * y.y) / sum(s) + {_ALPHA} * ln(2.0)', 'objective')} FROM y JOIN wt USING (id)"))
def objective_at_zero(spark, d):
    _, loss, problem, zero = _at_zero(spark, d)
    return spark.createDataFrame([(float(solver.objective(problem, zero, loss)),)], "objective double").select(r6("objective"))


@query(over(*_EMB, _GRAD, then=f"SELECT fid, lid, {q6('g')} FROM gz"))
def gradient_at_zero(spark, d):
    return _matrix(spark, _at_zero(spark, d)[0], "g")


@query(over(*_EMB, _GRAD, f"nm AS (SELECT fid, sqrt(sum(g * g)) AS size FROM gz GROUP BY fid)", then=f"SELECT fid, lid, {q6(f'g * greatest(0, 1 - {_BETA} / (size + 1e-12))', 'w')} FROM gz JOIN nm USING (fid)"))
def prox_group_lasso(spark, d):
    return _matrix(spark, solver.shrink_rows(_at_zero(spark, d)[0], _BETA), "w")


@query(over(*_EMB, _GRAD, f"nm AS (SELECT fid, sqrt(sum({_STEP} * g * {_STEP} * g)) AS size FROM gz GROUP BY fid)", then=f"SELECT fid, lid, {q6(f'-{_STEP} * g * greatest(0, 1 - {_STEP} * {_BETA} / (size + 2.220446049250313e-16))', 'w')} FROM gz JOIN nm USING (fid)"))
def fista_one_step(spark, d):
    return _matrix(spark, solver.shrink_rows(-_STEP * _at_zero(spark, d)[0], _STEP * _BETA, 2.220446049250313e-16), "w")


def _start(d: int) -> list[float]:
    """The seeded start of the power iteration, of length 1."""
    import numpy as np

    v = np.random.default_rng(0).standard_normal(d)
    return (v / (np.linalg.norm(v) + 1e-12)).tolist()


def eigenvalue_sql(d: int, steps: int = 25) -> tuple[str, ...]:
    """``eg``: the greatest eigenvalue of the weighted Gram matrix of x, by steps of the power iteration one after another."""
    g = "gg AS MATERIALIZED (SELECT i, list(g ORDER BY j) AS g FROM (SELECT a.fid AS i, b.fid AS j, sum(a.val * b.val * s) AS g FROM x a JOIN x b USING (id) JOIN wt USING (id) GROUP BY 1, 2) GROUP BY i)"
    by = "SELECT list(list_dot_product(g, v) ORDER BY i) AS u, any_value(v) AS v FROM gg, "
    each = [f"p{k + 1} AS MATERIALIZED (SELECT list_transform(u, lambda z: z / sqrt(list_dot_product(u, u))) AS v FROM ({by} p{k}))" for k in range(steps)]
    return g, f"p0 AS (SELECT {_start(d)}::DOUBLE[] AS v)", *each, f"eg AS MATERIALIZED (SELECT list_dot_product(v, u) AS eigenvalue FROM ({by} p{steps}))"


@query(over(BASKETS, LONG, FREQ, PRIOR, WEIGHTS, *eigenvalue_sql(10), then=f"SELECT {q6('eigenvalue')} FROM eg"))
def power_eigmax(spark, d):
    from rankweave.operators.sharded import row_blocks

    rows = row_blocks(solver.prepared(S.order_baskets(spark, d), EmbeddedParams())).persist()
    found = solver.matrix_free_eigenvalue(rows, 10)
    rows.unpersist()
    return spark.createDataFrame([(found,)], "eigenvalue double").select(r6("eigenvalue"))


STEPS = 3


def steps_sql(alpha: float, weighted: bool) -> tuple[str, ...]:
    """``wn``: the weights after some steps of the solver from zero. The lengths of the weights' rows don't depend on the orthogonal embedding of
    the labels, so each label is its own target here."""
    p = EmbeddedParams(alpha=alpha)
    weights_of = WEIGHTS if weighted else "wt AS (SELECT id, 1.0 AS s FROM f)"
    out = [
        TEXTS, LONG, FREQ, PRIOR, weights_of, *eigenvalue_sql(6),
        f"st AS MATERIALIZED (SELECT 0.9 / greatest({1 - alpha + alpha / 4} * eigenvalue + {2 * p.rho}, 1e-12) AS sw, 0.9 / ({alpha / 4} * (SELECT sum(s) FROM wt) + 1e-12) AS sb FROM eg)",
        "w0 AS MATERIALIZED (SELECT fid, lid, 0.0::DOUBLE AS w, 0.0::DOUBLE AS z FROM (SELECT DISTINCT fid FROM x), (SELECT DISTINCT lid FROM y))",
        "b0 AS MATERIALIZED (SELECT DISTINCT lid, 0.0::DOUBLE AS b, 0.0::DOUBLE AS zb FROM y)",
    ]
    t = 1.0
    for k in range(STEPS):
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        c = (last - 1) / t
        out += [
            f"l{k} AS MATERIALIZED (SELECT x.id, q.lid, any_value(s) * (sum(val * z) - any_value(y.y) / (1 + 1e-12)) AS r, any_value(s) * (1 / (1 + exp(-(sum(val * z) + any_value(zb)))) - any_value(y.y)) AS e"
            f" FROM x JOIN w{k} q USING (fid) JOIN y ON y.id = x.id AND y.lid = q.lid JOIN wt ON wt.id = x.id JOIN b{k} bb ON bb.lid = q.lid GROUP BY x.id, q.lid)",
            f"g{k} AS MATERIALIZED (SELECT fid, lid, sum(val * ({1 - alpha} * r + {alpha} * e)) AS g FROM x JOIN l{k} USING (id) GROUP BY fid, lid)",
            f"v{k} AS MATERIALIZED (SELECT fid, lid, w, z - sw * (g + {2 * p.rho} * z) AS v FROM w{k} JOIN g{k} USING (fid, lid), st)",
            f"n{k} AS MATERIALIZED (SELECT fid, sqrt(sum(v * v)) AS size FROM v{k} GROUP BY fid)",
            f"o{k} AS MATERIALIZED (SELECT fid, lid, w AS was, v * greatest(0, 1 - sw * {p.beta} / (size + 2.220446049250313e-16)) AS w FROM v{k} JOIN n{k} USING (fid), st)",
            f"w{k + 1} AS MATERIALIZED (SELECT fid, lid, w, w + {c} * (w - was) AS z FROM o{k})",
            f"c{k} AS MATERIALIZED (SELECT lid, b AS was, zb - sb * {alpha} * (SELECT sum(e) FROM l{k} WHERE l{k}.lid = b{k}.lid) AS b FROM b{k}, st)",
            f"b{k + 1} AS MATERIALIZED (SELECT lid, b, b + {c} * (b - was) AS zb FROM c{k})",
        ]
    return *out, f"sc AS (SELECT fid, sqrt(sum(w * w)) AS score FROM w{STEPS} GROUP BY fid)"


def _steps(variant: str, block: int | None = None, layout: str = "") -> None:
    alpha, weighted, _ = VARIANTS[variant]

    def run(spark, d):
        import numpy as np

        rows = S.text_rows(spark, d)
        if layout:
            rows = rows.withColumn("features", sparse(F.col("features")))
        return solver.fit_embedded(rows, EmbeddedParams(alpha=alpha, use_instance_weights=weighted, max_iter=STEPS), np.zeros((6, 2)), block)[0].select("rank", "fid", r6("score"))

    run.__name__ = f"embedded_steps_{variant}" + ("_in_blocks" if block else layout)
    query(over(*steps_sql(alpha, weighted), then=f"SELECT CAST(row_number() OVER (ORDER BY sc.score DESC, fid) AS INTEGER) AS rank, fid + 1 AS fid, {q6('score')} FROM sc"))(run)


for _variant in ("embedded", "regression", "logistic", "unweighted", "simple"):
    _steps(_variant)
for _variant in ("embedded", "simple"):
    _steps(_variant, 4)
    _steps(_variant, layout="_sparse")


def _embedded(name: str, variant: str) -> None:
    def run(spark, d):
        alpha, weighted, _ = VARIANTS[variant]
        return solver.fit_embedded(S.order_baskets(spark, d), EmbeddedParams(alpha=alpha, use_instance_weights=weighted))[0]

    run.__name__ = f"embedded_ranking_{name}"
    query()(run)


for _name, _variant in {"full": "embedded", "reg": "regression", "log": "logistic", "nowt": "unweighted", "simple": "simple"}.items():
    _embedded(_name, _variant)


_SUBSETS = (
    *graph_sql(),
    "ev AS (SELECT x.fid, sum(val * val) AS e, any_value(score) AS s FROM x JOIN bl USING (fid) GROUP BY x.fid)", _RANKED, _GRIDDED,
    f"ch AS MATERIALIZED (SELECT mu_e, mu_s, list(fid ORDER BY fid) AS sel FROM (SELECT *, row_number() OVER (PARTITION BY mu_e, mu_s ORDER BY score DESC, fid) AS r FROM gr) WHERE r <= {fusion.n_selected(64, 0.2)} GROUP BY 1, 2)",
    "sb AS MATERIALIZED (SELECT DISTINCT sel, array_to_string(sel, ',') AS subset FROM ch)",
    "u AS MATERIALIZED (SELECT subset, id, list_transform(v, lambda z: z / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM (SELECT subset, id, list_transform(sel, lambda i: features[i + 1]) AS v FROM f, sb))",
    FOLD,
    f"""nn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subset, fold, id ORDER BY sim DESC, near) AS rank FROM
  (SELECT a.subset, t.fold, a.id, b.id AS near, round(list_dot_product(a.v, b.v), 10) AS sim FROM (SELECT DISTINCT fold FROM fd) t, u a JOIN u b USING (subset) JOIN fd ON fd.id = b.id WHERE a.id <> b.id AND fd.fold <> t.fold)) WHERE rank <= {K})""",
    "ct AS MATERIALIZED (SELECT nn.subset, nn.fold, nn.id, lid, CAST(sum(y.y) AS INTEGER) AS c FROM nn JOIN y ON y.id = nn.near GROUP BY 1, 2, 3, 4)",
    "tr AS (SELECT t.fold, y.id, lid, y.y FROM (SELECT DISTINCT fold FROM fd) t, y JOIN fd ON fd.id = y.id WHERE fd.fold <> t.fold)",
    "mp AS (SELECT fold, lid, sum(y) AS pos, count(*) AS n, (1 + sum(y)) / (2.0 + count(*)) AS p1 FROM tr GROUP BY 1, 2)",
    "hs AS (SELECT subset, fold, lid, c, sum(tr.y) AS t, sum(1 - tr.y) AS f FROM ct JOIN tr USING (fold, id, lid) GROUP BY 1, 2, 3, 4)",
    f"mc AS (SELECT subset, fold, lid, k.c, (1 + coalesce(t, 0)) / ({K + 1}.0 + pos) AS p1, (1 + coalesce(hs.f, 0)) / ({K + 1}.0 + n - pos) AS p0 FROM mp CROSS JOIN (SELECT subset FROM sb) CROSS JOIN (SELECT CAST(unnest(range({K + 1})) AS INTEGER) AS c) k LEFT JOIN hs USING (subset, fold, lid, c))",
    "pd AS (SELECT subset, ct.fold, ct.id, lid, CAST(mp.p1 * mc.p1 >= 0.5 * (mp.p1 * mc.p1 + (1 - mp.p1) * mc.p0) AS INTEGER) AS pred, y.y FROM (SELECT ct.* FROM ct JOIN fd ON fd.id = ct.id AND fd.fold = ct.fold) ct JOIN mc USING (subset, fold, lid, c) JOIN mp USING (fold, lid) JOIN y USING (id, lid))",
    MICRO.replace("SELECT fold", "SELECT subset, fold").replace("BY fold", "BY subset, fold"),
    MACRO.replace("SELECT fold, lid", "SELECT subset, fold, lid").replace("SELECT fold, coalesce", "SELECT subset, fold, coalesce").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)").replace("BY fold", "BY subset, fold"),
    "gm AS (SELECT subset, sqrt(greatest(avg(micro), 0) * greatest(avg(macro), 0)) AS gm FROM mi JOIN ma USING (subset, fold) GROUP BY subset)",
)


@query(over(*_SUBSETS, then=f"SELECT mu_e, mu_s, {q6('gm')} FROM ch JOIN sb USING (sel) JOIN gm USING (subset)"))
def capacity_search(spark, d):
    rows = S.vectors(spark, d)
    x = S.feature_values(rows).groupBy("fid").agg(F.sum(F.col("val") * F.col("val")).alias("score"))
    s = spectral.spectral_scores(rows).select("fid", "score")
    return evaluate.capacity_scores(rows, fusion.rank_uniform(x), fusion.rank_uniform(s), SelectionParams(mlknn_k=K)).select("mu_e", "mu_s", r6("gm"))


@query()
def pipeline_full(spark, d):
    return rank_features(S.vectors(spark, d), "full")[0]
