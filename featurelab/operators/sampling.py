"""Deterministic training-set assembly and generation manifests.

Random draws are keyed by (seed, row id, ...) through :mod:`featurelab.functions.rng`,
so a retried task or a different partitioning gives the same rows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import vectors as V
from ..functions.permute import permuted, unpermuted
from .position import with_position

# Largest lookup table (estimated bytes) broadcast to every task; larger ones are joined normally.
BROADCAST_BYTE_LIMIT = 256 << 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def logit_normal_time(g, path: str = "linear") -> Column:
    """``sigma = exp(g)``; linear ``sigma / (1 + sigma)``, cosine ``2/pi atan(sigma)``."""
    sigma = F.exp(_c(g))
    if path == "linear":
        return sigma / (1 + sigma)
    if path == "cosine":
        return F.lit(2 / math.pi) * F.atan(sigma)
    raise NotImplementedError(path)


def sample_timesteps(key, seed, weighting: str = "uniform", path: str = "linear") -> Column:
    """One time value per row."""
    if weighting == "uniform":
        return rng.uniform(seed, _c(key), "t")
    if weighting == "lognormal":
        return logit_normal_time(rng.normal(seed, _c(key), "t"), path)
    raise NotImplementedError(weighting)


def label_dropout(label, p: float, num_classes: int, key=None, seed=0, force=None) -> Column:
    """The label becomes ``num_classes`` (the null class) when ``u < p`` or the
    force flag is 1."""
    lab = _c(label)
    if force is not None:
        drop = _c(force) == 1
    else:
        drop = rng.uniform(seed, _c(key), "drop") < F.lit(float(p))
    return F.when(drop, F.lit(int(num_classes))).otherwise(lab.cast("int"))


def _indexed(df: DataFrame, id_col: str, index_col: str | None) -> tuple[DataFrame, int]:
    """``df`` with its dense 0-based index as ``_fl_index``, and its row count.

    ``index_col`` is such an index already (checked); without one the rows are
    numbered in the order of their ids.
    """
    if index_col is None:
        return with_position(df, id_col, "_fl_index"), df.count()
    n, lo, hi, total = df.agg(F.count(F.lit(1)), F.min(index_col), F.max(index_col), F.sum(F.col(index_col).cast("decimal(38,0)"))).first()
    if n and (lo, hi, int(total)) != (0, n - 1, n * (n - 1) // 2):
        raise ValueError(f"{index_col} must number the rows from 0 to {n - 1}")
    return df.withColumn("_fl_index", F.col(index_col).cast("bigint")), n


def epoch_batches(df: DataFrame, id_col: str, batch: int, seed: int, epoch: int, index_col: str | None = None) -> DataFrame:
    """T4: rows in the order of a keyed permutation, in batches of ``batch``; the last partial one is dropped.

    Adds ``epoch``, ``batch_id`` and ``slot`` (position inside the batch).  Each row
    computes its own place, so with an index there is no shuffle and no sort.
    """
    rows, n = _indexed(df, id_col, index_col)
    keep = (n // batch) * batch
    placed = rows.withColumn("_fl_pos", unpermuted("_fl_index", max(1, n), seed, epoch))
    return (placed.where(F.col("_fl_pos") < F.lit(keep))
            .withColumn("epoch", F.lit(int(epoch)))
            .withColumn("batch_id", F.floor(F.col("_fl_pos") / F.lit(batch)).cast("bigint"))
            .withColumn("slot", F.pmod(F.col("_fl_pos"), F.lit(batch)).cast("int"))
            .drop("_fl_index", "_fl_pos"))


def local_batch_size(global_batch: int, processes: int) -> int:
    return int(global_batch // processes)


def infinite_sampler(df: DataFrame, id_col: str, rank: int, replicas: int, seed: int,
                     start: int, steps: int, index_col: str | None = None) -> DataFrame:
    """T5: the ids a rank reads at steps ``j = 0..steps-1``.

    Stream position ``idx = start + rank + j * replicas``; ``epoch = idx div N``;
    a keyed permutation per (seed, epoch).  A request computes the index of its
    row and finds it by one equi-join, whatever the number of epochs.
    """
    spark = df.sparkSession
    rows, n = _indexed(df.select(id_col, *([index_col] if index_col not in (None, id_col) else [])), id_col, index_col)
    if n == 0:
        raise ValueError("no rows to sample from")
    req = spark.range(steps).select(F.col("id").alias("j"),
                                    (F.lit(start + rank) + F.col("id") * F.lit(replicas)).alias("idx"))
    req = req.select("j", "idx", F.floor(F.col("idx") / F.lit(n)).cast("bigint").alias("epoch"))
    req = req.withColumn("_fl_index", permuted(F.pmod("idx", F.lit(n)), n, seed, F.col("epoch")))
    rows = rows.select("_fl_index", id_col)
    smaller, larger = (rows, req) if n <= steps else (req, rows)
    return larger.join(smaller.hint("shuffle_hash"), "_fl_index").select("j", "idx", "epoch", id_col)


def time_schedule(spark: SparkSession, n: int, cfg_scale: float = 1.0, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """K6: ``n`` points from 1 to 0.04, then 0; rows ``(i, t, t_next, dt, diffusion,
    noisy, guided)``.  The last interval (to 0) is the noise-free one."""
    step = (0.04 - 1.0) / (n - 1) if n > 1 else 0.0
    t_of = lambda c: F.when(c >= n, F.lit(0.0)).otherwise(F.lit(1.0) + c.cast("double") * F.lit(step))
    r = spark.range(n).select(F.col("id").cast("int").alias("i"))
    t, tn = t_of(F.col("i")), t_of(F.col("i") + 1)
    return r.select("i", t.alias("t"), tn.alias("t_next"), (tn - t).alias("dt"), (2 * t).alias("diffusion"),
                    (F.col("i") < n - 1).alias("noisy"),
                    V.guidance_active(t, cfg_scale, lo, hi).alias("guided"))


def generation_manifest(spark: SparkSession, num: int, world: int, batch: int, seed: int,
                        num_classes: int) -> DataFrame:
    """K5: sample indices as ranks write them.

    ``total = ceil(num / (world * batch)) * world * batch``; rank r at iteration
    it writes ``index = i * world + r + it * world * batch`` for slot i; its seed
    is ``seed * world + r``.  Indices ``>= num`` are surplus and dropped.
    """
    gb = world * batch
    total = int(math.ceil(num / gb) * gb)
    r = spark.range(total).select(F.col("id").alias("k"))
    it = F.floor(F.col("k") / F.lit(gb)).cast("bigint")
    within = F.pmod(F.col("k"), F.lit(gb))
    rank = F.floor(within / F.lit(batch)).cast("int")
    slot = F.pmod(within, F.lit(batch)).cast("int")
    out = r.select(it.alias("iteration"), rank.alias("rank"), slot.alias("slot"))
    out = out.select("*", (F.col("slot") * F.lit(world) + F.col("rank") + F.col("iteration") * F.lit(gb)).alias("index"),
                     (F.lit(seed * world) + F.col("rank")).alias("rank_seed"))
    label = F.floor(rng.uniform(F.col("rank_seed"), F.col("iteration"), F.col("slot"), "y") * F.lit(num_classes)).cast("int")
    return out.withColumn("label", label).where(F.col("index") < F.lit(num))


def label_table(features: DataFrame, num_classes: int, label_col: str = "label",
                feat_col: str = "features") -> DataFrame:
    """Class embedding table: mean feature per label plus a zero row for the null class."""
    x = F.col(feat_col).cast("array<double>")
    per = features.select(label_col, F.posexplode(x).alias("dim", "x")).groupBy(label_col, "dim").agg(
        F.avg("x").alias("m"))
    tab = per.groupBy(label_col).agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("_e")).select(
        F.col(label_col).cast("int").alias(label_col), F.transform("_e", lambda s: s["m"]).alias("embedding"))
    width = features.select(F.size(feat_col).alias("d")).first()["d"]
    spark = features.sparkSession
    zero = spark.range(1).select(F.lit(int(num_classes)).alias(label_col),
                                 F.array_repeat(F.lit(0.0), int(width)).alias("embedding"))
    return tab.unionByName(zero)


def lookup_embedding(df: DataFrame, table: DataFrame, label_col: str = "label",
                     emb_col: str = "embedding") -> DataFrame:
    """Label id to vector.  The table has ``num_classes + 1`` rows (a model
    size, not a data size).  Its size is measured (rows x widest vector x 8
    bytes); it is broadcast under ``BROADCAST_BYTE_LIMIT`` and joined normally
    above it."""
    m = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(emb_col)).alias("d")).first()
    est = int(m["n"] or 0) * (8 * int(m["d"] or 0) + 16)
    t = F.broadcast(table) if est <= BROADCAST_BYTE_LIMIT else table
    return df.join(t, label_col, "left")


def training_pairs(aligned: DataFrame, seed: int, num_classes: int, cfg_prob: float = 0.1,
                   path: str = "linear", weighting: str = "uniform", latent_scale: float = 0.18215,
                   latent_bias: float = 0.0, id_col: str = "id") -> DataFrame:
    """One narrow pipeline from aligned rows ``(id, moments, label, cls, patches)``
    to model inputs and targets.

    Posterior sample (V3), time (T2), label dropout (T3), class token + patch
    tokens (V5), noisy input / velocity target for latents and, with its own
    noise, for the class token (V11).
    """
    k = F.col(id_col)
    mean, std = V.split_moments("moments")
    x = V.sample_posterior(mean, std, seed, F.concat(F.lit("z:"), k.cast("string")), latent_scale, latent_bias)
    t = sample_timesteps(k, seed, weighting, path)
    eps = rng.normal_vector(seed, F.concat(F.lit("x:"), k.cast("string")), F.size(mean))
    eps_cls = rng.normal_vector(seed, F.concat(F.lit("c:"), k.cast("string")), F.size("cls"))
    df = aligned.select(id_col, x.alias("x"), t.alias("t"), "cls", "patches",
                        label_dropout("label", cfg_prob, num_classes, k, seed).alias("label"),
                        eps.alias("eps"), eps_cls.alias("eps_cls"))
    pair = V.noisy_pair("x", "eps", F.col("t"), path)
    cls_pair = V.noisy_pair("cls", "eps_cls", F.col("t"), path)
    return df.select(id_col, "t", "label", pair["input"].alias("model_input"), pair["target"].alias("model_target"),
                     cls_pair["input"].alias("cls_input"), cls_pair["target"].alias("cls_target"),
                     V.prepend_cls("cls", "patches").alias("zs"))
