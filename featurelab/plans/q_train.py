"""Registered queries of the training-input and generation families
(V1-V7, V10-V20, T1-T6, K5, K6, P9, P12, J6, O6) and their oracles."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import images as G
from ..functions import rng
from ..functions import vectors as V
from ..functions.permute import permuted_sql
from ..operators import sampling as S
from ..operators.align import collect_samples
from . import fixtures as fx
from .q_evaluate import rnd

SEED = 7
NUM_CLASSES = 10
N_STEPS = 25
CFG = 2.3
G_HIGH = 0.85


def _emb(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                                   F.col("embedding").cast("array<double>").alias("x"), "label")


def _long(df, key, col, name, digits=6):
    return df.select(key, F.posexplode(col).alias("i", name)).select(
        key, F.col("i").cast("int").alias("i"), rnd(name, digits).alias(name))


# ---------------------------------------------------------------- vectors
def q_mean_sum(spark, sf):
    e = _emb(spark, sf)
    return e.select("id", rnd(V.mean_flat("x")).alias("mean_flat"), rnd(V.sum_flat("x")).alias("sum_flat"))


def q_moments_split(spark, sf):
    m = fx.moments(spark, sf)
    packed = V.pack_moments("mean", "std")
    mean, std = V.split_moments(packed)
    return m.select("id", F.size(packed).alias("packed_size"), rnd(V.vsum(mean)).alias("mean_sum"),
                    rnd(V.vsum(std)).alias("std_sum"))


def q_sample_posterior(spark, sf):
    m = fx.moments(spark, sf)
    z = V.sample_posterior("mean", "std", SEED, F.col("id"), 0.18215, 0.0)
    return _long(m.select("id", z.alias("z")), "id", "z", "z")


def q_hidden_split(spark, sf):
    h = fx.hidden(spark, sf)
    cls, patches = V.split_hidden_tokens("tokens", 4)
    zs = V.prepend_cls(cls, patches)
    return h.select("id", F.size(patches).alias("n_patches"), F.size(zs).alias("n_tokens"),
                    rnd(V.vsum(cls)).alias("cls_sum"),
                    rnd(F.aggregate(patches, F.lit(0.0), lambda a, t: a + V.vsum(t))).alias("patch_sum"))


def q_storage_precision(spark, sf):
    e = _emb(spark, sf)
    f = F.transform(V.to_storage_precision(V.scale("x", 3.0)), lambda v: v.cast("double"))
    return _long(e.select("id", f.alias("v")), "id", "v", "v")


def q_l2_normalize(spark, sf):
    e = _emb(spark, sf)
    return _long(e.select("id", V.l2_normalize(V.scale("x", F.col("id") + 1)).alias("v")), "id", "v", "v")


def _t(spark, sf):
    e = _emb(spark, sf)
    return e.select("id", "x", "label", S.sample_timesteps(F.col("id"), SEED).alias("t"),
                    S.sample_timesteps(F.col("id"), SEED, "lognormal", "linear").alias("t_ln"),
                    S.sample_timesteps(F.col("id"), SEED, "lognormal", "cosine").alias("t_lc"))


def q_timesteps(spark, sf):
    t = _t(spark, sf)
    return t.select("id", rnd("t").alias("t"), rnd("t_ln").alias("t_ln"), rnd("t_lc").alias("t_lc"))


def q_interpolant(spark, sf):
    t = _t(spark, sf)
    lin, cos = V.interpolant(F.col("t"), "linear"), V.interpolant(F.col("t"), "cosine")
    return t.select("id", *[rnd(lin[f]).alias(f"lin_{f}") for f in ("alpha", "sigma", "d_alpha", "d_sigma")],
                    *[rnd(cos[f]).alias(f"cos_{f}") for f in ("alpha", "sigma", "d_alpha", "d_sigma")])


def _pred_t(spark, sf):
    p = fx.predictions(spark, sf)
    return p.select("k", "cond", "uncond", S.sample_timesteps(F.col("k"), SEED).alias("t"))


def q_noisy_pair_loss(spark, sf):
    p = _pred_t(spark, sf)
    pair = V.noisy_pair("cond", "uncond", F.col("t"), "cosine")
    return p.select("k", rnd(V.vsum(pair["input"])).alias("input_sum"),
                    rnd(V.vsum(pair["target"])).alias("target_sum"),
                    rnd(V.denoise_loss(pair["input"], pair["target"])).alias("loss"))


def _tokens_of(col):
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(F.col(col), t * 4 + 1, 4))


def q_alignment_loss(spark, sf):
    p = fx.predictions(spark, sf)
    l = p.select("k", V.alignment_loss(_tokens_of("cond"), _tokens_of("uncond")).alias("proj"))
    return l.select("k", rnd("proj").alias("proj_loss"))


def q_alignment_loss_batch(spark, sf):
    """V13 batch value over two encoders (pairs of token sets)."""
    p = fx.predictions(spark, sf)
    v = V.alignment_loss_batch([(_tokens_of("cond"), _tokens_of("uncond")), (_tokens_of("uncond"), _tokens_of("cond"))])
    return p.agg(rnd(v).alias("proj_loss_batch"))


def q_total_loss(spark, sf):
    p = _pred_t(spark, sf)
    pair = V.noisy_pair("cond", "uncond", F.col("t"), "linear")
    cls_pair = V.noisy_pair(F.slice("cond", 1, 8), F.slice("uncond", 1, 8), F.col("t"), "linear")
    rows = p.select(V.denoise_loss(pair["input"], pair["target"]).alias("l_img"),
                    V.alignment_loss(_tokens_of("cond"), _tokens_of("uncond")).alias("l_proj"),
                    V.denoise_loss(cls_pair["input"], cls_pair["target"]).alias("l_cls"))
    agg = rows.agg(V.total_loss("l_img", "l_proj", "l_cls", 0.5, 0.03).alias("t"), F.avg("l_img").alias("a"),
                   F.avg("l_proj").alias("b"), F.avg("l_cls").alias("c"))
    return agg.select(rnd("t").alias("total_loss"), rnd("a").alias("loss_mean"), rnd("b").alias("proj_loss"),
                      rnd("c").alias("loss_mean_cls"))


def q_score(spark, sf):
    p = _pred_t(spark, sf)
    s = V.score_from_velocity("cond", "uncond", F.col("t"), "linear")
    c = V.score_from_velocity("cond", "uncond", F.col("t"), "cosine")
    return p.select("k", rnd(V.vsum(s), 4).alias("score_lin"), rnd(V.vsum(c), 4).alias("score_cos"))


def q_guidance(spark, sf):
    p = fx.predictions(spark, sf)
    g = V.guidance_blend("cond", "uncond", CFG)
    c = V.guidance_blend(F.slice("cond", 1, 8), F.slice("uncond", 1, 8), F.lit(0.0), cond_only_if_nonpositive=True)
    return p.select("k", rnd(V.vsum(g)).alias("blend_sum"), rnd(V.vsum(c)).alias("cls_sum"))


def q_sde_step(spark, sf):
    """K6 + P12 + V15-V17: one sampler step per prediction row, step index ``k mod n``."""
    sched = S.time_schedule(spark, N_STEPS, CFG, 0.0, G_HIGH)
    p = fx.predictions(spark, sf).withColumn("i", F.pmod("k", F.lit(N_STEPS)).cast("int"))
    j = p.join(F.broadcast(sched), "i")
    d = V.drift("cond", "uncond", F.col("t"), "linear")
    eps = rng.normal_vector(SEED, F.col("k"), F.size("uncond"))
    x_next = V.sde_step("uncond", d, F.col("t"), F.col("t_next"), eps, ~F.col("noisy"))
    return j.select("k", "i", rnd("t").alias("t"), rnd("dt").alias("dt"), "guided", "noisy",
                    rnd(V.vsum(x_next), 4).alias("x_next_sum"))


def q_timestep_features(spark, sf):
    t = _t(spark, sf)
    return _long(t.select("id", V.timestep_features(F.col("t") * 1000, 9).alias("f")), "id", "f", "f")


def q_grid_positions(spark, sf):
    h = fx.hidden(spark, sf)
    pe = lambda p: V.grid_position_features(p, 4, 4)
    out = F.transform("tokens", lambda tok, p: V.add(tok, pe(p)))
    return h.select("id", rnd(F.aggregate(out, F.lit(0.0), lambda a, t: a + V.vsum(t))).alias("sum_with_pos"),
                    rnd(V.vsum(pe(F.lit(5)))).alias("pos5_sum"))


def q_unpatchify(spark, sf):
    h = fx.hidden(spark, sf)
    return _long(h.select("id", V.unpatchify("tokens", 2, 1).alias("img")), "id", "img", "v")


def q_shape_matches(spark, sf):
    """Rank equal and each non-null reference dimension equal."""
    ps = fx.param_shapes(spark, sf)
    return ps.select("tensor_id", V.shape_matches("shape", [None, 3]).alias("matches"))


# ---------------------------------------------------------------- training set
def q_label_dropout(spark, sf):
    e = _emb(spark, sf)
    return e.select("id", S.label_dropout("label", 0.1, NUM_CLASSES, F.col("id"), SEED).alias("label"),
                    S.label_dropout("label", 0.1, NUM_CLASSES, force=F.when(F.pmod("id", F.lit(5)) == 0, 1).otherwise(0)).alias("forced"))


def q_epoch_batches(spark, sf):
    e = _emb(spark, sf).select("id")
    return S.epoch_batches(e, "id", 32, SEED, 3, "id").select("id", "epoch", "batch_id", "slot")


def q_infinite_sampler(spark, sf):
    e = _emb(spark, sf).select("id")
    n = e.count()
    return S.infinite_sampler(e, "id", 1, 4, SEED, 100, n, "id")


def q_training_pairs(spark, sf):
    e = _emb(spark, sf)
    # moments and hidden tokens come from the same row: one projection, no join
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(F.col("x"), t * 4 + 1, 4))
    aligned = e.select("id", F.col("x").alias("moments"), "label", tokens.alias("tokens")).select(
        "id", "moments", "label", F.element_at("tokens", 1).alias("cls"), F.slice("tokens", 6, 11).alias("patches"))
    tp = S.training_pairs(aligned, SEED, NUM_CLASSES, 0.1)
    return tp.select("id", rnd("t").alias("t"), "label", rnd(V.mean_flat("model_input")).alias("input_mean"),
                     rnd(V.mean_flat("model_target")).alias("target_mean"),
                     rnd(V.mean_flat("cls_input")).alias("cls_input_mean"), F.size("zs").alias("n_tokens"))


# ---------------------------------------------------------------- generation
def q_generation_manifest(spark, sf):
    n = fx.ref_features(spark, sf).count()
    return S.generation_manifest(spark, n, 8, 16, SEED, 1000)


def q_lookup_embedding(spark, sf):
    e = fx.features(spark, sf)
    tab = S.label_table(e, NUM_CLASSES)
    dropped = e.select("id", S.label_dropout("label", 0.1, NUM_CLASSES, F.col("id"), SEED).alias("label"))
    j = S.lookup_embedding(dropped, tab)
    return j.select("id", "label", rnd(V.vsum("embedding")).alias("emb_sum"))


def q_collect_samples(spark, sf):
    n = fx.table(spark, sf, "embeddings").count()
    man = S.generation_manifest(spark, n, 8, 16, SEED, 1000)
    e = fx.table(spark, sf, "embeddings")
    imgs = e.select(F.col("vec_id").alias("index"), "label", G.quantize_pixels(F.col("embedding"), "truncate").alias("pixels"))
    got = collect_samples(man, imgs, n, values_col="pixels")
    return got.select("index", "label", F.size("pixels").alias("n_pixels"),
                      F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("pixel_sum"))


def q_rng(spark, sf):
    """Keyed uniform and normal draws per row."""
    e = _emb(spark, sf)
    return e.select("id", rnd(rng.uniform(SEED, F.col("id"))).alias("u"),
                    rnd(rng.normal(SEED, F.col("id"))).alias("n"))


QUERIES = {
    "train_rng": q_rng,
    "vec_mean_sum": q_mean_sum,
    "vec_moments_split": q_moments_split,
    "vec_sample_posterior": q_sample_posterior,
    "vec_hidden_split": q_hidden_split,
    "vec_storage_precision": q_storage_precision,
    "vec_l2_normalize": q_l2_normalize,
    "vec_interpolant": q_interpolant,
    "vec_noisy_pair_loss": q_noisy_pair_loss,
    "vec_alignment_loss": q_alignment_loss,
    "vec_alignment_loss_batch": q_alignment_loss_batch,
    "vec_total_loss": q_total_loss,
    "vec_score": q_score,
    "vec_guidance": q_guidance,
    "vec_timestep_features": q_timestep_features,
    "vec_grid_positions": q_grid_positions,
    "vec_unpatchify": q_unpatchify,
    "vec_shape_matches": q_shape_matches,
    "gen_sde_step": q_sde_step,
    "train_timesteps": q_timesteps,
    "train_label_dropout": q_label_dropout,
    "train_epoch_batches": q_epoch_batches,
    "train_infinite_sampler": q_infinite_sampler,
    "train_pairs": q_training_pairs,
    "gen_manifest": q_generation_manifest,
    "gen_lookup_embedding": q_lookup_embedding,
    "gen_collect_samples": q_collect_samples,
}


# ---------------------------------------------------------------- oracles
def f(x: float) -> str:
    """A double literal for DuckDB (plain decimals would be DECIMAL there)."""
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def u_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def n_sql(key: str) -> str:
    """Box-Muller normal of the key prefix (tags ``u`` and ``v`` appended)."""
    return (f"(sqrt({f(-2.0)} * ln({u_sql(key + chr(32) + '|| ' + repr(':u'))} + {f(rng.LOG_GUARD)})) * "
            f"cos({f(2 * 3.141592653589793)} * {u_sql(key + chr(32) + '|| ' + repr(':v'))}))")


def vs(x: str) -> str:
    return f"list_sum({x})"


def key(*parts: str) -> str:
    """DuckDB text of ``concat_ws(':', parts)`` where parts are SQL expressions."""
    return " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


_E = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"
_T = f"""SELECT id, x, label, {u_sql(key(repr(str(SEED)), 'id', "'t'"))} AS t,
  {n_sql(key(repr(str(SEED)), 'id', "'t'"))} AS g FROM ({_E})"""
_PT = f"""SELECT k, cond, uncond, {u_sql(key(repr(str(SEED)), 'k', "'t'"))} AS t FROM ({fx.PREDICTIONS_SQL})"""
_PI2 = f(3.141592653589793 / 2)


def _interp(t: str, path: str) -> tuple[str, str, str, str]:
    if path == "linear":
        return f"(1 - {t})", t, f(-1.0), f(1.0)
    a = f"({t} * {_PI2})"
    return f"cos({a})", f"sin({a})", f"({f(-3.141592653589793 / 2)} * sin({a}))", f"({_PI2} * cos({a}))"


def _axpby(a: str, x: str, b: str, y: str) -> str:
    return f"list_transform(list_zip({x}, {y}), lambda z: {a} * z[1] + {b} * z[2])"


def _long_sql(src: str, key_col: str, arr: str, name: str, n: int, digits: int = 6) -> str:
    return (f"SELECT {key_col}, CAST(i - 1 AS INTEGER) AS i, round0({arr}[i], {digits}) AS {name} "
            f"FROM ({src}), range(1, {n + 1}) r(i)")


def _dloss(p: str, t: str) -> str:
    return f"(list_sum(list_transform(list_zip({p}, {t}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len({p}))"


def _tokens(col: str) -> str:
    return f"list_transform(range(0, 16), lambda q: {col}[q * 4 + 1: q * 4 + 4])"


def _norm(v: str) -> str:
    return f"list_transform({v}, lambda a: a / greatest(sqrt(list_sum(list_transform({v}, lambda b: b * b))), 1e-12))"


def _align_loss(z: str, zp: str) -> str:
    cos = (f"list_transform(list_zip({_tokens(z)}, {_tokens(zp)}), lambda pr: "
           f"list_dot_product({_norm('pr[1]')}, {_norm('pr[2]')}))")
    return f"(-list_sum({cos}) / 16)"


def _score(v: str, x: str, t: str, path: str) -> str:
    a, s, da, ds = _interp(t, path)
    r = f"({a} / {da})"
    var = f"({s} * {s} - {r} * {ds} * {s})"
    return f"list_transform(list_zip({v}, {x}), lambda z: CASE WHEN {var} = 0 THEN NULL ELSE ({r} * z[1] - z[2]) / {var} END)"


_SCHED_STEP = (0.04 - 1.0) / (N_STEPS - 1)
_SCHED = f"""SELECT CAST(i AS INTEGER) AS i,
  CASE WHEN i >= {N_STEPS} THEN 0.0 ELSE 1.0 + i * {f(_SCHED_STEP)} END AS t,
  CASE WHEN i + 1 >= {N_STEPS} THEN 0.0 ELSE 1.0 + (i + 1) * {f(_SCHED_STEP)} END AS t_next,
  i < {N_STEPS - 1} AS noisy FROM range(0, {N_STEPS}) r(i)"""


def _sde_sql() -> str:
    eps = f"list_transform(range(0, len(uncond)), lambda e: {n_sql(key(repr(str(SEED)), 'k', 'e'))})"
    sc = _score("cond", "uncond", "t", "linear")
    d = f"list_transform(list_zip(cond, {sc}), lambda z: z[1] - 0.5 * (2 * t) * z[2])"
    return f"""WITH p AS (SELECT k, cond, uncond, CAST(k % {N_STEPS} AS INTEGER) AS i FROM ({fx.PREDICTIONS_SQL})),
s AS ({_SCHED}),
j AS (SELECT p.*, s.t, s.t_next, s.t_next - s.t AS dt, s.noisy,
        ({f(CFG)} > 1 AND s.t >= 0.0 AND s.t <= {f(G_HIGH)}) AS guided FROM p JOIN s USING (i)),
d AS (SELECT *, {d} AS dr, {eps} AS eps FROM j)
SELECT k, i, round0(t, 6) AS t, round0(dt, 6) AS dt, guided, noisy,
  round0(list_sum(CASE WHEN noisy THEN
      list_transform(list_zip(list_transform(list_zip(uncond, dr), lambda z: z[1] + z[2] * dt), eps),
                     lambda z: z[1] + sqrt(2 * t) * z[2] * sqrt(abs(dt)))
    ELSE list_transform(list_zip(uncond, dr), lambda z: z[1] + dt * z[2]) END), 4) AS x_next_sum
FROM d"""


def _tf_sql() -> str:
    half = 4
    fr = f"exp({f(-math.log(10000.0))} * q / {f(float(half))})"
    feats = (f"list_concat(list_transform(range(0, {half}), lambda q: cos(t * 1000 * {fr})), "
             f"list_transform(range(0, {half}), lambda q: sin(t * 1000 * {fr})), [0.0])")
    return _long_sql(f"SELECT id, {feats} AS f FROM ({_T})", "id", "f", "f", 9)


def _pe_sql(p: str) -> str:
    om = f"(1.0 / pow(10000.0, q / {f(1.0)}))"
    col, row = f"CAST({p} % 4 AS DOUBLE)", f"CAST(floor({p} / 4) AS DOUBLE)"
    one = lambda c: (f"list_concat(list_transform(range(0, 1), lambda q: sin({c} * {om})), "  # noqa: E731
                     f"list_transform(range(0, 1), lambda q: cos({c} * {om})))")
    return f"list_concat({one(col)}, {one(row)})"


def _grid_sql() -> str:
    toks = f"list_transform(range(0, 16), lambda p: list_transform(list_zip(tokens[p + 1], {_pe_sql('p')}), lambda z: z[1] + z[2]))"
    return f"""SELECT id, round0(list_sum(list_transform({toks}, lambda t: list_sum(t))), 6) AS sum_with_pos,
  round0(list_sum({_pe_sql('5')}), 6) AS pos5_sum FROM ({fx.HIDDEN_SQL})"""


def _unpatch_sql() -> str:
    # p = 2, c = 1, 16 tokens -> 8 x 8
    el = "tokens[(floor(y / 2) * 4 + floor(x / 2))::INTEGER + 1][((y % 2) * 2 + (x % 2))::INTEGER + 1]"
    return f"""SELECT id, CAST(o AS INTEGER) AS i, round0({el}, 6) AS v FROM (
  SELECT id, tokens, o, (o % 64) // 8 AS y, (o % 64) % 8 AS x FROM ({fx.HIDDEN_SQL}), range(0, 64) r(o))"""


def _pairs_sql() -> str:
    # T6 over embeddings: moments = x, cls = token 0, patches = tokens 5..15
    mean, std = "x[1:32]", "x[33:64]"
    epsz = f"list_transform(range(0, 32), lambda e: {n_sql(key(repr(str(SEED)), chr(39) + 'z:' + chr(39) + ' || CAST(id AS VARCHAR)', 'e'))})"
    epsx = f"list_transform(range(0, 32), lambda e: {n_sql(key(repr(str(SEED)), chr(39) + 'x:' + chr(39) + ' || CAST(id AS VARCHAR)', 'e'))})"
    epsc = f"list_transform(range(0, 4), lambda e: {n_sql(key(repr(str(SEED)), chr(39) + 'c:' + chr(39) + ' || CAST(id AS VARCHAR)', 'e'))})"
    z = (f"list_transform(list_zip(list_zip({mean}, {std}), {epsz}), "
         f"lambda q: (q[1][1] + q[1][2] * q[2]) * {f(0.18215)} + {f(0.0)})")
    drop = f"{u_sql(key(repr(str(SEED)), 'id', repr('drop')))} < {f(0.1)}"
    return f"""WITH a AS (SELECT id, label, x, x[1:4] AS cls, {z} AS z, {epsx} AS ex, {epsc} AS ec,
    {u_sql(key(repr(str(SEED)), 'id', "'t'"))} AS t,
    CASE WHEN {drop} THEN {NUM_CLASSES} ELSE CAST(label AS INTEGER) END AS lab FROM ({_E}))
SELECT id, round0(t, 6) AS t, lab AS label,
  round0(list_avg({_axpby('(1 - t)', 'z', 't', 'ex')}), 6) AS input_mean,
  round0(list_avg({_axpby('-1.0', 'z', '1.0', 'ex')}), 6) AS target_mean,
  round0(list_avg({_axpby('(1 - t)', 'cls', 't', 'ec')}), 6) AS cls_input_mean,
  12 AS n_tokens
FROM a"""


def _manifest_sql() -> str:
    gb = 8 * 16
    return f"""WITH n AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 2 = 0),
r AS (SELECT k FROM n, range(0, CAST(ceil(n / {gb}) * {gb} AS BIGINT)) t(k)),
m AS (SELECT CAST(k // {gb} AS BIGINT) AS iteration, CAST((k % {gb}) // 16 AS INTEGER) AS rank,
             CAST(k % 16 AS INTEGER) AS slot FROM r),
o AS (SELECT *, slot * 8 + rank + iteration * {gb} AS "index", {SEED * 8} + rank AS rank_seed FROM m)
SELECT iteration, rank, slot, CAST("index" AS BIGINT) AS "index", rank_seed,
  CAST(floor({u_sql(key('rank_seed', 'iteration', 'slot', "'y'"))} * 1000) AS INTEGER) AS label
FROM o, n WHERE "index" < n.n"""


def _lookup_sql() -> str:
    drop = f"{u_sql(key(repr(str(SEED)), 'id', repr('drop')))} < {f(0.1)}"
    return f"""WITH e AS ({fx.FEATURES_SQL}),
tab AS (SELECT label, sum(s) AS emb_sum FROM (
          SELECT label, i, avg(features[i]) AS s FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label
        UNION ALL SELECT {NUM_CLASSES}, 0.0),
d AS (SELECT id, CASE WHEN {drop} THEN {NUM_CLASSES} ELSE label END AS label FROM e)
SELECT d.id, d.label, round0(tab.emb_sum, 6) AS emb_sum FROM d LEFT JOIN tab USING (label)"""


ORACLES = {
    "train_rng": f"""SELECT id, round0({u_sql(key(repr(str(SEED)), 'id'))}, 6) AS u,
  round0({n_sql(key(repr(str(SEED)), 'id'))}, 6) AS n FROM ({_E})""",
    "vec_mean_sum": f"SELECT id, round0(list_avg(x), 6) AS mean_flat, round0(list_sum(x), 6) AS sum_flat FROM ({_E})",
    "vec_moments_split": f"""SELECT id, CAST(len(list_concat(mean, std)) AS INTEGER) AS packed_size,
  round0(list_sum(mean), 6) AS mean_sum, round0(list_sum(std), 6) AS std_sum FROM ({fx.MOMENTS_SQL})""",
    "vec_sample_posterior": _long_sql(
        f"""SELECT id, list_transform(list_zip(list_zip(mean, std), list_transform(range(0, 32), lambda e: {n_sql(key(repr(str(SEED)), 'id', 'e'))})),
           lambda q: (q[1][1] + q[1][2] * q[2]) * {f(0.18215)} + {f(0.0)}) AS z FROM ({fx.MOMENTS_SQL})""", "id", "z", "z", 32),
    "vec_hidden_split": f"""SELECT id, 11 AS n_patches, 12 AS n_tokens, round0(list_sum(tokens[1]), 6) AS cls_sum,
  round0(list_sum(list_transform(tokens[6:16], lambda t: list_sum(t))), 6) AS patch_sum FROM ({fx.HIDDEN_SQL})""",
    "vec_storage_precision": _long_sql(f"SELECT id, list_transform(x, lambda v: CAST(CAST(v * 3.0 AS FLOAT) AS DOUBLE)) AS v FROM ({_E})",
                                       "id", "v", "v", 64),
    "vec_l2_normalize": _long_sql(f"SELECT id, {_norm('list_transform(x, lambda v: v * (id + 1))')} AS v FROM ({_E})",
                                  "id", "v", "v", 64),
    "train_timesteps": f"""SELECT id, round0(t, 6) AS t, round0(exp(g) / (1 + exp(g)), 6) AS t_ln,
  round0({f(2 / 3.141592653589793)} * atan(exp(g)), 6) AS t_lc FROM ({_T})""",
    "vec_interpolant": "SELECT id, " + ", ".join(
        f"round0({e}, 6) AS {p}_{n}" for p, path in (("lin", "linear"), ("cos", "cosine"))
        for n, e in zip(("alpha", "sigma", "d_alpha", "d_sigma"), _interp("t", path))) + f" FROM ({_T})",
    "vec_noisy_pair_loss": f"""SELECT k, round0(list_sum(inp), 6) AS input_sum, round0(list_sum(tgt), 6) AS target_sum,
  round0({_dloss('inp', 'tgt')}, 6) AS loss FROM (
  SELECT k, {_axpby(_interp('t', 'cosine')[0], 'cond', _interp('t', 'cosine')[1], 'uncond')} AS inp,
            {_axpby(_interp('t', 'cosine')[2], 'cond', _interp('t', 'cosine')[3], 'uncond')} AS tgt FROM ({_PT}))""",
    "vec_alignment_loss": f"SELECT k, round0({_align_loss('cond', 'uncond')}, 6) AS proj_loss FROM ({fx.PREDICTIONS_SQL})",
    "vec_alignment_loss_batch": f"""SELECT round0(sum({_align_loss('cond', 'uncond')} + {_align_loss('uncond', 'cond')}) / (2 * count(*)), 6)
  AS proj_loss_batch FROM ({fx.PREDICTIONS_SQL})""",
    "vec_total_loss": f"""WITH r AS (SELECT
    {_dloss(_axpby('(1 - t)', 'cond', 't', 'uncond'), _axpby('-1.0', 'cond', '1.0', 'uncond'))} AS l_img,
    {_align_loss('cond', 'uncond')} AS l_proj,
    {_dloss(_axpby('(1 - t)', 'cond[1:8]', 't', 'uncond[1:8]'), _axpby('-1.0', 'cond[1:8]', '1.0', 'uncond[1:8]'))} AS l_cls
  FROM ({_PT}))
SELECT round0(avg(l_img) + avg(l_proj) * 0.5 + avg(l_cls) * 0.03, 6) AS total_loss, round0(avg(l_img), 6) AS loss_mean,
  round0(avg(l_proj), 6) AS proj_loss, round0(avg(l_cls), 6) AS loss_mean_cls FROM r""",
    "vec_score": f"""SELECT k, round0(list_sum({_score('cond', 'uncond', 't', 'linear')}), 4) AS score_lin,
  round0(list_sum({_score('cond', 'uncond', 't', 'cosine')}), 4) AS score_cos FROM ({_PT})""",
    "vec_guidance": f"""SELECT k, round0(list_sum(list_transform(list_zip(cond, uncond), lambda z: z[2] + {f(CFG)} * (z[1] - z[2]))), 6) AS blend_sum,
  round0(list_sum(cond[1:8]), 6) AS cls_sum FROM ({fx.PREDICTIONS_SQL})""",
    "vec_timestep_features": _tf_sql(),
    "vec_grid_positions": _grid_sql(),
    "vec_unpatchify": _unpatch_sql(),
    "vec_shape_matches": f"SELECT tensor_id, (len(shape) = 2 AND shape[2] = 3) AS matches FROM ({fx.PARAM_SHAPES_SQL})",
    "gen_sde_step": _sde_sql(),
    "train_label_dropout": f"""SELECT id,
  CASE WHEN {u_sql(key(repr(str(SEED)), 'id', repr('drop')))} < {f(0.1)} THEN {NUM_CLASSES} ELSE label END AS label,
  CASE WHEN id % 5 = 0 THEN {NUM_CLASSES} ELSE label END AS forced FROM ({_E})""",
    "train_epoch_batches": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings),
{permuted_sql('SELECT r.j, 3 AS epoch, r.j AS q FROM n, range(0, (n.n // 32) * 32) r(j)', str(SEED))},
k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS x FROM embeddings)
SELECT id, epoch::INTEGER AS epoch, j // 32 AS batch_id, (j % 32)::INTEGER AS slot FROM permuted JOIN k USING (x)""",
    "train_infinite_sampler": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings),
{permuted_sql('SELECT r.j, (101 + r.j * 4) // n.n AS epoch, (101 + r.j * 4) % n.n AS q FROM n, range(0, n.n) r(j)', str(SEED))},
k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS x FROM embeddings)
SELECT j, 101 + j * 4 AS idx, epoch, id FROM permuted JOIN k USING (x)""",
    "train_pairs": _pairs_sql(),
    "gen_manifest": _manifest_sql(),
    "gen_lookup_embedding": _lookup_sql(),
    "gen_collect_samples": """SELECT vec_id AS "index", label, len(embedding) AS n_pixels,
  CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: floor(least(greatest((v + 1.0) / 2.0 * 255.0, 0.0), 255.0)))) AS BIGINT) AS pixel_sum
FROM embeddings""",
}
