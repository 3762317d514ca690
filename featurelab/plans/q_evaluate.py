"""Registered queries of the evaluation family (flagship) and their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance, stats
from . import evaluate
from .sqltext import frechet_by_label_sql, frechet_sql
from . import fixtures as fx

R = 6  # digits kept in double outputs (both engines)


def rnd(c, digits=R):
    """Round a double and fold -0.0 into 0.0 (the oracle does the same)."""
    return F.round(c, digits) + F.lit(0.0)


def q_knn_radii(spark, sf):
    r = distance.knn_radii(fx.features(spark, sf), "id", "features", ks=(3,))
    return r.select("id", rnd("radius", R).alias("radius"))


def q_knn_radii_multi_k(spark, sf):
    r = distance.knn_radii(fx.features(spark, sf), "id", "features", ks=(1, 3, 5), block_rows=128)
    return r.select("id", *[rnd(F.element_at("radii", i + 1), R).alias(f"radius_k{k}")
                            for i, k in enumerate((1, 3, 5))])


def q_precision_recall(spark, sf):
    pr = distance.precision_recall(fx.ref_features(spark, sf), fx.sample_features(spark, sf), k=3)
    return pr.select(rnd("precision", R).alias("precision"), rnd("recall", R).alias("recall"))


def q_precision_recall_blocked(spark, sf):
    """Same answer with small blocks (many block pairs per side)."""
    pr = distance.precision_recall(fx.ref_features(spark, sf), fx.sample_features(spark, sf), k=3,
                                   block_rows=64)
    return pr.select(rnd("precision", R).alias("precision"), rnd("recall", R).alias("recall"))


def q_manifold_evaluate(spark, sf):
    ref = fx.ref_features(spark, sf)
    radii = distance.knn_radii(ref, "id", "features", ks=(3,))
    m = distance.manifold_evaluate(ref, radii, fx.sample_features(spark, sf))
    return m.select("id", "inside", rnd("max_realism", 4).alias("max_realism"), "nearest_id",
                    rnd("nearest_dist", R).alias("nearest_dist"))


def q_nearest(spark, sf):
    n = distance.nearest(fx.ref_features(spark, sf), fx.sample_features(spark, sf), block_rows=100)
    return n.select("id", "nearest_id", rnd("nearest_dist", R).alias("nearest_dist"))


def q_pairwise_summary(spark, sf):
    s = distance.pairwise_distance_summary(fx.sample_features(spark, sf), fx.ref_features(spark, sf),
                                           block_rows=100)
    return s.select("id", "n_pairs", rnd("min_dist", R).alias("min_dist"),
                    rnd("max_dist", R).alias("max_dist"), rnd("sum_dist", 4).alias("sum_dist"))


def q_pair_distance(spark, sf):
    """V8 on rows already paired (prediction pairs)."""
    p = fx.predictions(spark, sf)
    return p.select("k", rnd(distance.squared_distance("cond", "uncond"), R).alias("sq_dist"))


def q_clamp_radii(spark, sf):
    r = distance.knn_radii(fx.features(spark, sf), "id", "features", ks=(3,))
    c = distance.clamp_radii(r, 90.0)
    return c.select("id", rnd("radius", R).alias("radius"))


def q_feature_mean(spark, sf):
    return stats.feature_mean(fx.features(spark, sf)).select("dim", rnd("mean", R).alias("mean"))


def q_feature_cov(spark, sf):
    return stats.feature_cov(fx.features(spark, sf)).select("i", "j", rnd("cov", R).alias("cov"))


def q_frechet_terms(spark, sf):
    t = stats.frechet_terms(fx.ref_features(spark, sf), fx.sample_features(spark, sf))
    return t.select(*[rnd(c, R).alias(c) for c in t.columns])


def q_frechet_terms_spatial(spark, sf):
    """A5 (sFID part): mean and trace terms on the spatial features (first 32 dims)."""
    sp = lambda df: df.withColumn("features", F.slice("features", 1, 32))
    t = stats.frechet_terms(sp(fx.ref_features(spark, sf)), sp(fx.sample_features(spark, sf)))
    return t.select(*[rnd(c).alias(c) for c in t.columns])


def q_inception_score(spark, sf):
    s = stats.inception_score(fx.probs(spark, sf).where(F.pmod("id", F.lit(2)) == 1), "probs", "id")
    return s.select(rnd("inception_score", R).alias("inception_score"), "n_chunks")


def q_inception_score_chunked(spark, sf):
    s = stats.inception_score(fx.probs(spark, sf), "probs", "id", split_size=64)
    return s.select(rnd("inception_score", R).alias("inception_score"), "n_chunks")


def q_probs(spark, sf):
    p = fx.probs(spark, sf)
    return p.select("id", F.posexplode("probs").alias("c", "p")).select(
        "id", F.col("c").cast("int").alias("c"), rnd("p", R).alias("p"))


def q_grouped_stats(spark, sf):
    g = stats.grouped_feature_statistics(fx.features(spark, sf), "label")
    return g.select("label", "n", rnd("trace_cov", R).alias("trace_cov"),
                    rnd(F.aggregate("mu", F.lit(0.0), lambda a, x: a + x), R).alias("mu_sum"))


def q_linear_softmax(spark, sf):
    """V9 with a fixed head W = 20 * I[:, :10] (a model weight, not data)."""
    import numpy as np
    w = np.eye(64)[:, :10] * 20.0
    p = stats.linear_softmax(fx.features(spark, sf), w)
    return p.select("id", F.posexplode("probs").alias("c", "p")).select(
        "id", F.col("c").cast("int").alias("c"), rnd("p").alias("p"))


def q_membership_flags(spark, sf):
    """J5 + U3: per-row membership in both directions (merged block flags)."""
    ref, smp = fx.ref_features(spark, sf), fx.sample_features(spark, sf)
    r1 = distance.knn_radii(ref)
    r2 = distance.knn_radii(smp)
    return distance.membership_flags(ref, r1, smp, r2, block_rows=100).select("side", "id", "inside")


def q_fid_per_label(spark, sf):
    """The first four features of the reference rows against the sample rows of each label."""
    side = lambda df: df.select("label", F.slice("features", 1, 4).alias("features"))
    out = stats.frechet_by_set(side(fx.ref_features(spark, sf)), side(fx.sample_features(spark, sf)), "label")
    return out.withColumn("fid", rnd("fid", 5))


def q_fid(spark, sf):
    return evaluate.fid_only(spark, sf).select(rnd("fid", R).alias("fid"),
                                               (F.abs("self_fid") < 1e-9).alias("self_is_zero"))


def q_evaluation_report(spark, sf):
    return evaluate.evaluation_report(spark, sf).withColumn("value", rnd("value", R))


QUERIES = {
    "eval_knn_radii": q_knn_radii,
    "eval_knn_radii_multi_k": q_knn_radii_multi_k,
    "eval_precision_recall": q_precision_recall,
    "eval_precision_recall_blocked": q_precision_recall_blocked,
    "eval_manifold": q_manifold_evaluate,
    "eval_nearest": q_nearest,
    "eval_pairwise_summary": q_pairwise_summary,
    "eval_pair_distance": q_pair_distance,
    "eval_clamp_radii": q_clamp_radii,
    "eval_feature_mean": q_feature_mean,
    "eval_feature_cov": q_feature_cov,
    "eval_frechet_terms": q_frechet_terms,
    "eval_frechet_terms_spatial": q_frechet_terms_spatial,
    "eval_inception_score": q_inception_score,
    "eval_inception_score_chunked": q_inception_score_chunked,
    "eval_probs": q_probs,
    "eval_grouped_stats": q_grouped_stats,
    "eval_linear_softmax": q_linear_softmax,
    "eval_membership_flags": q_membership_flags,
    "eval_fid": q_fid,
    "eval_fid_per_label": q_fid_per_label,
    "eval_report": q_evaluation_report,
}

# ---------------------------------------------------------------- oracles (DuckDB)
_NORMS = """
nrm AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM {src})
"""


def _pairs(a: str, b: str) -> str:
    return (f"(SELECT a.id AS id, b.id AS oid, greatest(a.nn - 2 * list_dot_product(a.x, b.x) + b.nn, 0) AS d "
            f"FROM {a} a, {b} b)")


def _radii_sql(src_sql: str, name: str, k: int = 3) -> str:
    return f"""
{name}_f AS ({src_sql}),
{name}_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM {name}_f),
{name}_d AS {_pairs(name + '_n', name + '_n')},
{name}_r AS (SELECT id, d AS r FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn
             FROM {name}_d) WHERE rn = {k + 1})
"""


KNN_SQL = "WITH " + _radii_sql(fx.FEATURES_SQL, "a") + "SELECT id, round0(r, 6) AS radius FROM a_r"

KNN_MULTI_SQL = f"""
WITH a_f AS ({fx.FEATURES_SQL}),
a_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM a_f),
a_d AS {_pairs('a_n', 'a_n')},
a_s AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM a_d)
SELECT id, round0(max(d) FILTER (WHERE rn = 2), 6) AS radius_k1, round0(max(d) FILTER (WHERE rn = 4), 6) AS radius_k3,
       round0(max(d) FILTER (WHERE rn = 6), 6) AS radius_k5
FROM a_s GROUP BY id
"""

PR_SQL = ("WITH " + _radii_sql(fx.REF_SQL, "r") + "," + _radii_sql(fx.SAMPLE_SQL, "s") + """,
rr AS (SELECT r_n.*, r_r.r FROM r_n JOIN r_r USING (id)),
sr AS (SELECT s_n.*, s_r.r FROM s_n JOIN s_r USING (id)),
pd AS (SELECT rr.id AS rid, sr.id AS sid, rr.r AS rr, sr.r AS sr,
              greatest(rr.nn - 2 * list_dot_product(rr.x, sr.x) + sr.nn, 0) AS d FROM rr, sr),
prec AS (SELECT sid, bool_or(d <= rr) AS inside FROM pd GROUP BY sid),
rec AS (SELECT rid, bool_or(d <= sr) AS inside FROM pd GROUP BY rid)
SELECT round0((SELECT avg(CAST(inside AS DOUBLE)) FROM prec), 6) AS precision,
       round0((SELECT avg(CAST(inside AS DOUBLE)) FROM rec), 6) AS recall
""")

MANIFOLD_SQL = ("WITH " + _radii_sql(fx.REF_SQL, "r") + f""",
e_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM ({fx.SAMPLE_SQL})),
rr AS (SELECT r_n.*, r_r.r FROM r_n JOIN r_r USING (id)),
pd AS (SELECT e.id AS id, rr.id AS rid, rr.r AS r,
              greatest(e.nn - 2 * list_dot_product(e.x, rr.x) + rr.nn, 0) AS d FROM e_n e, rr)
SELECT id, bool_or(d <= r) AS inside, round0(max(r / (d + 1e-5)), 4) AS max_realism,
       arg_min(rid, (d, rid)) AS nearest_id, round0(min(d), 6) AS nearest_dist
FROM pd GROUP BY id
""")

NEAREST_SQL = f"""
WITH r_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM ({fx.REF_SQL})),
e_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM ({fx.SAMPLE_SQL})),
pd AS (SELECT e.id AS id, r.id AS rid, greatest(e.nn - 2 * list_dot_product(e.x, r.x) + r.nn, 0) AS d
       FROM e_n e, r_n r)
SELECT id, arg_min(rid, (d, rid)) AS nearest_id, round0(min(d), 6) AS nearest_dist FROM pd GROUP BY id
"""

PAIRWISE_SQL = f"""
WITH r_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM ({fx.REF_SQL})),
e_n AS (SELECT id, features AS x, list_sum(list_transform(features, lambda z: z * z)) AS nn FROM ({fx.SAMPLE_SQL})),
pd AS (SELECT e.id AS id, greatest(e.nn - 2 * list_dot_product(e.x, r.x) + r.nn, 0) AS d FROM e_n e, r_n r)
SELECT id, count(*) AS n_pairs, round0(min(d), 6) AS min_dist, round0(max(d), 6) AS max_dist,
       round0(sum(d), 4) AS sum_dist
FROM pd GROUP BY id
"""

PAIR_DISTANCE_SQL = f"""
SELECT k, round0(greatest(list_sum(list_transform(cond, lambda z: z * z))
                         - 2 * list_dot_product(cond, uncond)
                         + list_sum(list_transform(uncond, lambda z: z * z)), 0), 6) AS sq_dist
FROM ({fx.PREDICTIONS_SQL})
"""

CLAMP_SQL = ("WITH " + _radii_sql(fx.FEATURES_SQL, "a") + """,
cut AS (SELECT quantile_cont(r, 0.9) AS c FROM a_r)
SELECT id, round0(CASE WHEN r > (SELECT c FROM cut) THEN 0.0 ELSE r END, 6) AS radius FROM a_r
""")

_EXPLODED = f"""
SELECT id, label, CAST(i - 1 AS INTEGER) AS dim, features[i] AS x
FROM ({fx.FEATURES_SQL}), range(1, 65) t(i)
"""

FEATURE_MEAN_SQL = f"SELECT dim, round0(avg(x), 6) AS mean FROM ({_EXPLODED}) GROUP BY dim"

FEATURE_COV_SQL = f"""
WITH e AS ({_EXPLODED})
SELECT a.dim AS i, b.dim AS j, round0(covar_samp(a.x, b.x), 6) AS cov
FROM e a JOIN e b ON a.id = b.id GROUP BY a.dim, b.dim
"""

FRECHET_TERMS_SQL = f"""
WITH e AS ({_EXPLODED}),
r AS (SELECT dim, avg(x) AS mu, var_samp(x) AS v FROM e WHERE id % 2 = 0 GROUP BY dim),
s AS (SELECT dim, avg(x) AS mu, var_samp(x) AS v FROM e WHERE id % 2 = 1 GROUP BY dim)
SELECT round0(sum((r.mu - s.mu) * (r.mu - s.mu)), 6) AS mean_term, round0(sum(r.v), 6) AS trace_ref,
       round0(sum(s.v), 6) AS trace_sample
FROM r JOIN s USING (dim)
"""


def _is_sql(where: str, split: int) -> str:
    return f"""
WITH p AS (SELECT id, probs, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({fx.PROBS_SQL}) {where}),
x AS (SELECT pos // {split} AS chunk, id, c, probs[c] AS p FROM p, range(1, 11) t(c)),
pbar AS (SELECT chunk, c, avg(p) AS pb FROM x GROUP BY chunk, c),
kl AS (SELECT x.chunk, x.id,
              sum(CASE WHEN x.p <= 0 THEN CAST('NaN' AS DOUBLE) ELSE x.p * (ln(x.p) - ln(pbar.pb)) END) AS kl
       FROM x JOIN pbar USING (chunk, c) GROUP BY x.chunk, x.id),
sc AS (SELECT chunk, exp(avg(kl)) AS score FROM kl GROUP BY chunk)
SELECT round0(avg(score), 6) AS inception_score, count(*) AS n_chunks FROM sc
"""


PROBS_LONG_SQL = f"""
SELECT id, CAST(c - 1 AS INTEGER) AS c, round0(probs[c], 6) AS p FROM ({fx.PROBS_SQL}), range(1, 11) t(c)
"""

GROUPED_STATS_SQL = f"""
WITH e AS ({_EXPLODED}),
g AS (SELECT label, dim, count(*) AS n, avg(x) AS mu, var_samp(x) AS v FROM e GROUP BY label, dim)
SELECT label, max(n) AS n, round0(sum(v), 6) AS trace_cov, round0(sum(mu), 6) AS mu_sum FROM g GROUP BY label
"""

MEMBERSHIP_SQL = ("WITH " + _radii_sql(fx.REF_SQL, "r") + "," + _radii_sql(fx.SAMPLE_SQL, "s") + """,
rr AS (SELECT r_n.*, r_r.r FROM r_n JOIN r_r USING (id)),
sr AS (SELECT s_n.*, s_r.r FROM s_n JOIN s_r USING (id)),
pd AS (SELECT rr.id AS rid, sr.id AS sid, rr.r AS rr, sr.r AS sr,
              greatest(rr.nn - 2 * list_dot_product(rr.x, sr.x) + sr.nn, 0) AS d FROM rr, sr)
SELECT 'sample' AS side, sid AS id, bool_or(d <= rr) AS inside FROM pd GROUP BY sid
UNION ALL SELECT 'ref', rid, bool_or(d <= sr) FROM pd GROUP BY rid
""")

FID_SQL = "WITH RECURSIVE " + frechet_sql("f", 64) + """
SELECT round0(fid, 6) AS fid, abs(self_fid) < 1e-9 AS self_is_zero FROM fid_f"""

#: the five numbers as ``(o, metric, value)``; ``columns`` picks from them
REPORT_SQL = ("WITH RECURSIVE " + frechet_sql("f", 64) + "," + frechet_sql("s", 32) + ",\nis_ AS (" + _is_sql("WHERE id % 2 = 1", 5000)
              + "),\npr_ AS (" + PR_SQL + """)
SELECT {columns} FROM (
  SELECT 0 AS o, 'Inception Score' AS metric, inception_score AS value FROM is_
  UNION ALL SELECT 1, 'FID', round0(fid, 6) FROM fid_f UNION ALL SELECT 2, 'sFID', round0(fid, 6) FROM fid_s
  UNION ALL SELECT 3, 'Precision', precision FROM pr_ UNION ALL SELECT 4, 'Recall', recall FROM pr_)""")

ORACLES = {
    "eval_membership_flags": MEMBERSHIP_SQL,
    "eval_knn_radii": KNN_SQL,
    "eval_knn_radii_multi_k": KNN_MULTI_SQL,
    "eval_precision_recall": PR_SQL,
    "eval_precision_recall_blocked": PR_SQL,
    "eval_manifold": MANIFOLD_SQL,
    "eval_nearest": NEAREST_SQL,
    "eval_pairwise_summary": PAIRWISE_SQL,
    "eval_pair_distance": PAIR_DISTANCE_SQL,
    "eval_clamp_radii": CLAMP_SQL,
    "eval_feature_mean": FEATURE_MEAN_SQL,
    "eval_feature_cov": FEATURE_COV_SQL,
    "eval_frechet_terms": FRECHET_TERMS_SQL,
    "eval_frechet_terms_spatial": FRECHET_TERMS_SQL.replace("FROM e WHERE id % 2 = 0", "FROM e WHERE id % 2 = 0 AND dim < 32")
                                                   .replace("FROM e WHERE id % 2 = 1", "FROM e WHERE id % 2 = 1 AND dim < 32"),
    "eval_inception_score": _is_sql("WHERE id % 2 = 1", 5000),
    "eval_inception_score_chunked": _is_sql("", 64),
    "eval_probs": PROBS_LONG_SQL,
    "eval_linear_softmax": PROBS_LONG_SQL,
    "eval_grouped_stats": GROUPED_STATS_SQL,
    "eval_fid": FID_SQL,
    "eval_fid_per_label": frechet_by_label_sql(4),
    "eval_report": REPORT_SQL.format(columns="CAST(o AS INTEGER) AS metric_order, metric, value"),
}
