"""The flagship: evaluate a sample set against a reference set.

Five numbers, as the source's evaluator reports them: Inception Score on the
sample probabilities, FID on pooled features, sFID on spatial features,
k-NN precision and recall (k = 3).

Jobs: one scan + one shuffle for all four statistics (2 sets x 2 feature
columns), one blocked job for the radii of both sets, one for the
memberships, one aggregate for the Inception Score.  The driver only
finishes the two D x D matrix square roots.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distance, stats
from ..sources.files import ingest_array_batches, load_or_compute_stats
from . import fixtures as fx

REPORT_ORDER = ["Inception Score", "FID", "sFID", "Precision", "Recall"]


def evaluation_numbers(ref: DataFrame, smp: DataFrame, smp_probs: DataFrame, k: int = 3,
                       split_size: int = 5000, feat_col: str = "features", spatial_col: str = "spatial",
                       block_rows: int | None = distance.DEFAULT_BLOCK_ROWS, ref_stats: str | None = None) -> dict:
    """``ref`` / ``smp``: ``(id, features, spatial)``; ``smp_probs``: ``(id, probs)``.
    ``ref_stats``: stored statistics of the reference (S7), used where present.

    The three parts are independent Spark jobs; they are submitted from
    driver threads so the scheduler can overlap them on the cluster.
    """
    def inception():
        return stats.inception_score(smp_probs, "probs", "id", split_size).first()

    def statistics():
        if ref_stats:
            stored = [load_or_compute_stats(ref, ref_stats, c, spatial=c == spatial_col) for c in (feat_col, spatial_col)]
            own = stats.fit_statistics_multi(smp, [feat_col, spatial_col])
            return tuple(stats.frechet_distance(own[(None, c)], st) for c, st in zip((feat_col, spatial_col), stored))
        both = (ref.select(F.lit("ref").alias("_set"), feat_col, spatial_col)
                .unionByName(smp.select(F.lit("sample").alias("_set"), feat_col, spatial_col)))
        st = stats.fit_statistics_multi(both, [feat_col, spatial_col], "_set")
        return (stats.frechet_distance(st[("sample", feat_col)], st[("ref", feat_col)]),
                stats.frechet_distance(st[("sample", spatial_col)], st[("ref", spatial_col)]))

    def manifold():
        return distance.precision_recall(ref.select("id", feat_col), smp.select("id", feat_col), k=k,
                                         feat_col=feat_col, block_rows=block_rows).first()

    with ThreadPoolExecutor(max_workers=3) as pool:
        f_is, f_st, f_pr = pool.submit(inception), pool.submit(statistics), pool.submit(manifold)
        is_row, (fid, sfid), pr = f_is.result(), f_st.result(), f_pr.result()
    return {"Inception Score": float(is_row["inception_score"]), "FID": fid, "sFID": sfid,
            "Precision": float(pr["precision"]), "Recall": float(pr["recall"])}


def evaluation_from_batches(spark: SparkSession, ref: str, smp: str, make_extractor, ref_stats: str | None = None,
                            member: str = "arr_0", **options) -> dict:
    """The five numbers from two folders (or files) of ``.npz`` batches.

    ``make_extractor()`` gives, once per worker, a function from a batch of
    arrays ``[n, *shape]`` to a dict of ``features``, ``spatial`` and ``probs``
    (``[n, d]`` each).  The extractor runs once per array; its output is staged.
    """
    import numpy as np
    import pandas as pd

    from ..operators.position import with_position
    from ..session import stage

    def extracted(folder, name):
        rows = ingest_array_batches(spark, folder, member).select("path", "row", "shape", "values")

        def run(batches):
            fn = make_extractor()
            for pdf in batches:
                for shape, part in pdf.groupby(pdf["shape"].map(tuple), sort=False):
                    out = fn(np.stack(part["values"].tolist()).reshape(len(part), *(int(x) for x in shape)))
                    yield pd.DataFrame({"path": part["path"].values, "row": part["row"].values,
                                        **{k: list(np.asarray(out[k], dtype=np.float64)) for k in ("features", "spatial", "probs")}})

        done = stage(rows.mapInPandas(run, "path string, row long, features array<double>, spatial array<double>, probs array<double>"), name)
        place = with_position(done.select("path", "row"), ["path", "row"], "id")
        return done.join(place, ["path", "row"]).select("id", "features", "spatial", "probs")

    a, b = extracted(ref, "ref-features"), extracted(smp, "sample-features")
    return evaluation_numbers(a, b, b.select("id", "probs"), ref_stats=ref_stats, **options)


def _with_spatial(df: DataFrame) -> DataFrame:
    """Spatial features of the fixture: the first 32 dimensions (same row)."""
    return df.withColumn("spatial", F.slice("features", 1, 32))


def evaluation_report(spark: SparkSession, sf_dir: str, k: int = 3, split_size: int = 5000) -> DataFrame:
    """O4 as a five-row ``(metric_order, metric, value)`` table."""
    ref = _with_spatial(fx.ref_features(spark, sf_dir))
    smp = _with_spatial(fx.sample_features(spark, sf_dir))
    smp_probs = fx.probs(spark, sf_dir).where(F.pmod("id", F.lit(2)) == 1)
    nums = evaluation_numbers(ref, smp, smp_probs, k=k, split_size=split_size)
    rows = [(i, name, float(nums[name])) for i, name in enumerate(REPORT_ORDER)]
    return spark.createDataFrame(rows, "metric_order int, metric string, value double")


def fid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.features(spark, sf_dir).withColumn(
        "_set", F.when(F.pmod("id", F.lit(2)) == 0, "ref").otherwise("sample"))
    st = stats.fit_statistics_multi(both, ["features"], "_set")
    fid = stats.frechet_distance(st[("sample", "features")], st[("ref", "features")])
    self_fid = stats.frechet_distance(st[("ref", "features")], st[("ref", "features")])
    return spark.createDataFrame([(float(fid), float(self_fid))], "fid double, self_fid double")
