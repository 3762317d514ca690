"""Feature statistics, Frechet distance and Inception Score.

Covariance is a two-level aggregate.  Each task turns its rows into a partial
``(n, sum, Gram)`` over data shifted by one fixed row (a one-pass, shifted
moments form that avoids the cancellation of raw moments), emitting ``D``
rows ``(i, G[i, :])`` plus one row for the sums.  The merge groups by ``i``
with ``Summarizer.sum`` (a partial-aggregating vector sum).  The input is
coalesced first to at most as many tasks as there are slots or shuffle
partitions, so the shuffled bytes are ``tasks * D^2`` whatever the row count is.  Only the final ``D x D``
matrix (fixed by the feature width) reaches the driver, and only where the
matrix square root of the Frechet distance needs it.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_parallelism
from .position import chunk_id, with_position

SUMS_ROW = -1
# Partials (one D x D matrix per set and column) a task holds before it sends them on.
HELD_SETS = 16


@dataclass
class FeatureStats:
    """Fixed-size statistics of a feature set (``mu`` D, ``sigma`` D x D)."""
    n: int
    mu: np.ndarray
    sigma: np.ndarray


def _double_array(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def feature_mean(df: DataFrame, feat_col: str = "features") -> DataFrame:
    """A1: per-dimension mean as ``(dim, mean)`` rows (``dim`` 0-based)."""
    m = df.select(Summarizer.mean(array_to_vector(_double_array(feat_col))).alias("m"))
    return m.select(F.posexplode(vector_to_array("m")).alias("dim", "mean")) \
        .select(F.col("dim").cast("int"), "mean")


def _scan_tasks(spark) -> int:
    """Tasks that build partials: each sends D x D values, so their number is bounded, but
    not by the slots alone, which dynamic allocation may report as very few at the start."""
    return max(default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shift_vector(df: DataFrame, feat_col: str) -> np.ndarray:
    row = df.select(_double_array(feat_col).alias("f")).where(F.col("f").isNotNull()).first()
    if row is None:
        raise ValueError("feature statistics of an empty set")
    return np.asarray(row["f"], dtype=np.float64)


def gram_partials(df: DataFrame, feat_col: str = "features", max_tasks: int | None = None,
                  shift: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Merged shifted moments: rows ``(i, n, g)``; row ``i=-1`` holds the shifted sum.

    ``g`` for ``i >= 0`` is row i of ``sum (x-k)(x-k)^T``; ``n`` is the row count
    (on the sums row only).
    """
    spark = df.sparkSession
    if shift is None:
        shift = _shift_vector(df, feat_col)
    k = shift.copy()
    d = len(k)
    tasks = max_tasks or _scan_tasks(spark)
    src = df.select(_double_array(feat_col).alias("f")).where(F.col("f").isNotNull())
    src = src.coalesce(tasks)  # no-op when there are already fewer partitions

    def partial(batches):
        n = 0
        s = np.zeros(d)
        g = np.zeros((d, d))
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.vstack(pdf["f"].values) - k
            n += x.shape[0]
            s += x.sum(axis=0)
            g += x.T @ x
        if n == 0:
            return
        rows = [(SUMS_ROW, n, s)] + [(i, 0, g[i]) for i in range(d)]
        yield pd.DataFrame({"i": [r[0] for r in rows], "n": [r[1] for r in rows],
                            "g": [r[2] for r in rows]})

    parts = src.mapInPandas(partial, schema="i int, n long, g array<double>")
    merged = (parts.groupBy("i")
              .agg(F.sum("n").alias("n"),
                   vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")))
    return merged, k


def fit_statistics(df: DataFrame, feat_col: str = "features", max_tasks: int | None = None) -> FeatureStats:
    """A3: ``(n, mu, sigma)`` with ``np.cov`` semantics (ddof = 1)."""
    return fit_statistics_multi(df, [feat_col], None, max_tasks)[(None, feat_col)]


def _merged_moments(df: DataFrame, feat_cols: list[str], set_col: str | None, max_tasks: int | None) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows ``(_set, col, i, n, g)``: the shifted sums (``i`` = ``SUMS_ROW``) and the upper triangle of the Gram matrix, and the shifts."""
    spark = df.sparkSession
    sel = [F.col(set_col).cast("string").alias("_set") if set_col else F.lit(None).cast("string").alias("_set")]
    sel += [_double_array(c).alias(f"_f{j}") for j, c in enumerate(feat_cols)]
    src = df.select(*sel)
    # one row gives the shifts of all columns; only if no row has them all, one row per column
    names = [f"_f{j}" for j in range(len(feat_cols))]
    row = src.select(*names).dropna().first()
    shifts = []
    for c in names:
        first = row or src.select(c).where(F.col(c).isNotNull()).first()
        if first is None:
            raise ValueError("feature statistics of an empty set")
        shifts.append(np.asarray(first[c], dtype=np.float64))
    tasks = max_tasks or _scan_tasks(spark)
    src = src.coalesce(tasks)  # no-op when there are already fewer partitions
    ncol = len(feat_cols)

    def send(acc):
        rows = []
        for (key, j), (n, sm, g) in acc.items():
            rows.append((key, j, SUMS_ROW, n, sm))
            # symmetric: ship the upper triangle only (row i holds g[i, i:])
            rows.extend((key, j, i, 0, g[i, i:]) for i in range(g.shape[0]))
        acc.clear()
        return pd.DataFrame(rows, columns=["_set", "col", "i", "n", "g"])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("_set", dropna=False, sort=False):
                key = None if (isinstance(key, float) and np.isnan(key)) else key
                if (key, 0) not in acc and len(acc) >= HELD_SETS * ncol:
                    yield send(acc)
                for j in range(ncol):
                    x = [v for v in part[f"_f{j}"].values if v is not None]
                    if not x:
                        continue
                    x = np.vstack(x) - shifts[j]
                    a = acc.setdefault((key, j), [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
                    a[0] += x.shape[0]
                    a[1] += x.sum(axis=0)
                    a[2] += x.T @ x
        if acc:
            yield send(acc)

    parts = src.mapInPandas(partial, schema="_set string, col int, i int, n long, g array<double>")
    merged = (parts.groupBy("_set", "col", "i")
              .agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")))
    return merged, shifts


def _stats_of(rows: dict[int, tuple[int, np.ndarray]], shift: np.ndarray) -> FeatureStats:
    """Statistics from the rows ``i -> (n, g)`` of one set and column."""
    d = len(shift)
    n, sm = int(rows[SUMS_ROW][0]), np.asarray(rows[SUMS_ROW][1])
    g = np.zeros((d, d))
    for i in range(d):
        g[i, i:] = rows[i][1]
    g = np.triu(g) + np.triu(g, 1).T
    sigma = (g - np.outer(sm, sm) / n) / (n - 1) if n > 1 else np.full((d, d), np.nan)
    return FeatureStats(n, shift + sm / n, sigma)


def fit_statistics_multi(df: DataFrame, feat_cols: list[str], set_col: str | None = None,
                         max_tasks: int | None = None) -> dict:
    """A3 for several feature columns and sets in ONE scan and one shuffle.

    Returns ``{(set, column): FeatureStats}`` (set ``None`` without ``set_col``).
    Each task keeps one shifted ``(n, sum, Gram)`` per (set, column) and sends
    them on whenever it holds ``HELD_SETS`` sets, so its memory does not depend
    on how many sets there are or how they are mixed over the tasks.
    """
    merged, shifts = _merged_moments(df, feat_cols, set_col, max_tasks)
    rows: dict = {}
    for r in merged.collect():  # (sets x columns x (D + 1)) rows: for few sets; frechet_by_set takes any number
        rows.setdefault((r["_set"], r["col"]), {})[r["i"]] = (r["n"], r["g"])
    return {(key, feat_cols[j]): _stats_of(rr, shifts[j]) for (key, j), rr in rows.items()}


def feature_cov(df: DataFrame, feat_col: str = "features", max_tasks: int | None = None) -> DataFrame:
    """A2: covariance (ddof = 1) as ``(i, j, cov)`` rows, computed in Spark.

    The merged partials are ``D x D`` values (feature width, not data size).
    """
    merged, _ = gram_partials(df, feat_col, max_tasks)
    # D + 1 rows: gathered once into one row and split again, so the Gram matrix is computed once
    rows = merged.groupBy().agg(
        F.max(F.when(F.col("i") == SUMS_ROW, F.struct("n", F.col("g").alias("s")))).alias("t"),
        F.collect_list(F.when(F.col("i") != SUMS_ROW, F.struct("i", "g"))).alias("gram"))
    flat = rows.select("t", F.explode("gram").alias("r")).select("t", F.col("r.i").alias("i"), F.posexplode("r.g").alias("j", "g"))
    s_i, s_j = F.get("t.s", F.col("i")), F.get("t.s", F.col("j"))
    return flat.select(F.col("i").cast("int"), F.col("j").cast("int"),
                       ((F.col("g") - s_i * s_j / F.col("t.n")) / (F.col("t.n") - F.lit(1))).alias("cov"))


# ------------------------------------------------------------------ A4 / A5
def _sym_sqrt(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2.0)
    return (v * np.sqrt(np.clip(w, 0.0, None))) @ v.T


def trace_sqrt_product(s1: np.ndarray, s2: np.ndarray) -> float:
    """``tr(sqrtm(s1 @ s2))`` for symmetric PSD inputs, as
    ``sum sqrt(eig(s1^1/2 s2 s1^1/2))`` (same spectrum, symmetric, no scipy)."""
    h = _sym_sqrt(s1)
    w = np.linalg.eigvalsh(h @ s2 @ h)
    return float(np.sqrt(np.clip(w, 0.0, None)).sum())


def frechet_distance(a: FeatureStats, b: FeatureStats) -> float:
    """A4: squared 2-Wasserstein distance of two normal laws,
    ``|mu_a - mu_b|^2 + tr(A + B - 2 (A^1/2 B A^1/2)^1/2)``.

    The root is that of one symmetric matrix with its eigenvalues clipped at
    zero, so singular covariances need no special case.
    """
    widths = {len(x) for st in (a, b) for x in (st.mu, st.sigma)} | {st.sigma.shape[-1] for st in (a, b)}
    if len(widths) != 1:
        raise ValueError(f"statistics of different feature widths: {sorted(widths)}")
    gap = a.mu - b.mu
    return float(gap @ gap + np.trace(a.sigma + b.sigma) - 2.0 * trace_sqrt_product(a.sigma, b.sigma))


def frechet_by_set(ref: DataFrame, smp: DataFrame, set_col: str, feat_col: str = "features", max_tasks: int | None = None) -> DataFrame:
    """A4 / N2 for any number of sets: ``(set, n_ref, n_sample, fid)`` of the reference and sample rows of each set.

    The moments of a set meet in one task, which holds two ``D x D`` matrices and
    solves the root; no matrix reaches the driver.  A set that one side lacks, or
    of which it has a single row, has a null distance; rows of a null set take no part.
    """
    rows = [df.where(F.col(set_col).isNotNull() & F.col(feat_col).isNotNull()).select(
        F.concat(F.lit(side), F.col(set_col).cast("string")).alias("_key"), F.col(feat_col).alias("_feat")) for side, df in (("r", ref), ("s", smp))]
    both = rows[0].unionByName(rows[1])
    schema = f"{set_col} string, n_ref long, n_sample long, fid double"
    if both.limit(1).count() == 0:
        return ref.sparkSession.createDataFrame([], schema).withColumn(set_col, F.col(set_col).cast(ref.schema[set_col].dataType))
    merged, (shift,) = _merged_moments(both, ["_feat"], "_key", max_tasks)
    parts = merged.select(F.substring("_set", 1, 1).alias("side"), F.expr("substring(_set, 2)").alias("name"), "i", "n", "g")

    def solve(key, pdf):
        stats = {side: _stats_of({int(i): (n, g) for i, n, g in zip(p["i"], p["n"], p["g"])}, shift) for side, p in pdf.groupby("side")}
        n = {side: stats[side].n if side in stats else 0 for side in "rs"}
        fid = frechet_distance(stats["r"], stats["s"]) if min(n.values()) > 1 else None
        return pd.DataFrame({set_col: [key[0]], "n_ref": [n["r"]], "n_sample": [n["s"]], "fid": pd.Series([fid], dtype="float64")})

    out = parts.groupBy("name").applyInPandas(solve, schema)
    return out.withColumn(set_col, F.col(set_col).cast(ref.schema[set_col].dataType)).withColumn("fid", F.when(~F.isnan("fid"), F.col("fid")))


def frechet_terms(ref: DataFrame, smp: DataFrame, feat_col: str = "features") -> DataFrame:
    """The SQL-checkable part of A4: ``|mu1-mu2|^2``, ``tr(S1)``, ``tr(S2)`` as one row.

    Per-dimension ``avg`` and ``var_samp`` after ``posexplode``; the explode
    stays inside the scan stage and the partial aggregate keeps D rows per task.
    """
    def per_dim(df, tag):
        return (df.select(F.posexplode(_double_array(feat_col)).alias("dim", "x"))
                .groupBy("dim").agg(F.avg("x").alias(f"mu_{tag}"), F.var_samp("x").alias(f"var_{tag}")))
    j = per_dim(ref, "r").join(per_dim(smp, "s"), "dim")
    return j.agg(F.sum((F.col("mu_r") - F.col("mu_s")) ** 2).alias("mean_term"),
                 F.sum("var_r").alias("trace_ref"), F.sum("var_s").alias("trace_sample"))


# ------------------------------------------------------------------ V9 / A6
def softmax(c: str | Column) -> Column:
    """Max-shifted softmax of an array column (in double)."""
    x = _double_array(c)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    tot = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / tot)


def linear_softmax(df: DataFrame, weights: np.ndarray, feat_col: str = "features",
                   out_col: str = "probs") -> DataFrame:
    """V9: ``softmax(x @ W)`` (no bias).  ``W`` (D x C, fixed by the model) ships
    in the task closure; rows stream through in Arrow batches."""
    w = np.asarray(weights, dtype=np.float64)
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def apply(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = np.vstack(pdf[feat_col].values).astype(np.float64) @ w
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            yield pdf.assign(**{out_col: list(z)})

    return df.mapInPandas(apply, schema=out_schema)


def inception_score(df: DataFrame, probs_col: str = "probs", order_col: str = "id",
                    split_size: int = 5000) -> DataFrame:
    """Mean over consecutive chunks of ``exp(mean_i KL(p_i || pbar))``.

    Per chunk ``mean_i sum_c p ln(p / pbar_c) = mean_i sum_c p ln p - sum_c pbar_c ln pbar_c``,
    so one grouped aggregate per chunk (row count, sum of ``p ln p``, vector
    sum of ``p``) suffices and no row is joined back.  ``p = 0`` gives NaN as
    in the source.  The short last chunk counts like the others.
    Returns one row ``(inception_score, n_chunks)``.
    """
    p = _double_array(probs_col)
    plogp = F.aggregate(F.col("p"), F.lit(0.0),
                        lambda acc, v: acc + F.when(v <= 0, F.lit(float("nan"))).otherwise(v * F.log(v)))
    base = df.select(order_col, p.alias("p"))
    pos = with_position(base, order_col)
    per_chunk = (pos.withColumn("chunk", chunk_id("pos", split_size))
                 .groupBy("chunk")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum(plogp).alias("sum_plogp"),
                      vector_to_array(Summarizer.sum(array_to_vector("p"))).alias("psum")))
    pbar_term = F.aggregate(F.col("psum"), F.lit(0.0),
                            lambda acc, s: acc + F.when(s <= 0, F.lit(float("nan")))
                            .otherwise((s / F.col("n")) * F.log(s / F.col("n"))))
    scores = per_chunk.select(F.exp(F.col("sum_plogp") / F.col("n") - pbar_term).alias("score"))
    return scores.agg(F.avg("score").alias("inception_score"), F.count(F.lit(1)).alias("n_chunks"))


def grouped_feature_statistics(df: DataFrame, group_col: str, feat_col: str = "features") -> DataFrame:
    """N2 grouped: per group ``(n, mean vector, trace of covariance)``.

    Plain partial aggregates per (group, dimension), so a hot group is
    combined map-side; the collected mean vector has one entry per dimension.
    Full per-group covariances come from :func:`fit_statistics_multi` with the
    group as the set column.
    """
    x = _double_array(feat_col)
    return (df.select(group_col, F.posexplode(x).alias("dim", "x"))
            .groupBy(group_col, "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"),
                                            F.var_samp("x").alias("var"))
            .groupBy(group_col).agg(F.max("n").alias("n"),
                                    F.sort_array(F.collect_list(F.struct("dim", "mu"))).alias("_m"),
                                    F.sum("var").alias("trace_cov"))
            .select(group_col, "n", F.transform("_m", lambda s: s["mu"]).alias("mu"), "trace_cov"))
