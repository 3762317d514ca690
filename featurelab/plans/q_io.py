"""Registered queries of the source, sink, streaming, scoring and pixel families
(S1-S9, N1, N3, G5, P3, O1-O5, M1-M3) and their oracles.

File inputs are derived from the tables first (:mod:`.materialize`), so every
query still reads the driver tables and grows with them.
"""
from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import images as IM
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import scoring as SC
from ..operators import stats
from ..sinks import writers as W
from ..sources import files as S
from ..streaming import jobs as ST
from . import fixtures as fx
from . import materialize as MZ
from .q_evaluate import rnd
from .sqltext import resample_sql

PROB_COLS = 10


def _base(col="path"):
    return F.element_at(F.split(F.col(col), "/"), -1)


# ---------------------------------------------------------------- sources
def q_scan_images(spark, sf):
    root = MZ.write_image_folder(spark, sf)
    df = S.scan_images(spark, root)
    return df.select("rel_path", "idx", "label")


def q_scan_images_manifest(spark, sf):
    root = MZ.write_image_folder(spark, sf, with_manifest=True)
    return S.scan_images(spark, root).select("rel_path", "idx", "label")


def q_read_pixels(spark, sf):
    root = MZ.write_image_folder(spark, sf)
    imgs = IM.read_images(spark, root + "/*/*.png")
    return imgs.select(_base("path").alias("name"), F.col("image.height").alias("height"),
                       F.col("image.width").alias("width"), _pixel_sum(F.col("image.data")).alias("pixel_sum"))


def _pixel_sum(data):
    """Sum of the bytes of a binary column (vectorised over Arrow batches)."""
    return F.pandas_udf(_byte_sum_impl, "long")(data)


def _byte_sum_impl(s):
    import numpy as np
    import pandas as pd
    return pd.Series([int(np.frombuffer(b, dtype=np.uint8).sum(dtype=np.int64)) for b in s], dtype="int64")


def _placed_sum_impl(s):
    """Sum of the first channel's bytes, each times its place."""
    import numpy as np
    import pandas as pd
    return pd.Series([int((np.frombuffer(b, np.uint8)[::3].astype(np.int64) * np.arange(1, len(b) // 3 + 1)).sum()) for b in s], dtype="int64")


def q_convert_dataset(spark, sf):
    """The whole conversion flow (scan, folder labels, decode, box-halve to 4 x 4,
    uniform check, PNG files under 5-digit prefixes, manifest); the written
    files are decoded again and summed."""
    from .prepare import convert_dataset
    src = MZ.write_image_folder(spark, sf)
    dest = MZ.fresh_folder(spark, "converted")
    labelled = convert_dataset(spark, src, dest, "center-crop-dhariwal", 4, 4)
    back = IM.read_images(spark, dest, "path", recursive=True).select(
        F.regexp_extract("path", r"(\d{5}/img\d{8}\.png)$", 1).alias("archive_path"),
        _pixel_sum(F.col("image.data")).alias("pixel_sum"))
    return labelled.join(back, "archive_path").select("archive_path", "label", "pixel_sum")


def q_convert_roundtrip(spark, sf):
    """Labels survive the conversion: the written folder (three copies of each
    image, so more than one prefix folder) is scanned again."""
    from .prepare import convert_dataset
    src = MZ.write_image_folder(spark, sf, copies=3)
    dest = MZ.fresh_folder(spark, "converted")
    convert_dataset(spark, src, dest, "center-crop-dhariwal", 4, 4)
    return S.scan_images(spark, dest).select("rel_path", "idx", "label")


def q_convert_quarantine(spark, sf):
    """Grey and alpha images become RGB; files that do not decode, and images too
    small for the crop, are quarantined, none is lost."""
    from .prepare import convert_dataset
    src = MZ.write_image_folder(spark, sf, odd=True)
    dest = MZ.fresh_folder(spark, "converted")
    good = convert_dataset(spark, src, dest, "center-crop", 4, 4)
    back = IM.read_images(spark, dest, "path", recursive=True).select(
        F.regexp_extract("path", r"(\d{5}/img\d{8}\.png)$", 1).alias("archive_path"), "image")
    bad = spark.read.parquet(dest + "/_rejected")
    return good.join(back, "archive_path", "left").select("idx", F.col("image.nChannels").alias("channels"), F.lit(None).cast("string").alias("error")) \
        .unionByName(bad.select("idx", F.lit(None).cast("int").alias("channels"), "error"))


def q_convert_archive(spark, sf):
    """The conversion from zip archives, labels from their own manifests."""
    from .prepare import convert_dataset
    src = MZ.write_archives(spark, sf)
    dest = MZ.fresh_folder(spark, "converted")
    labelled = convert_dataset(spark, src + "/*.zip", dest, "center-crop-dhariwal", 4, 4)
    back = IM.read_images(spark, dest, "path", recursive=True).select(
        F.regexp_extract("path", r"(\d{5}/img\d{8}\.png)$", 1).alias("archive_path"),
        _pixel_sum(F.col("image.data")).alias("pixel_sum"))
    return labelled.join(back, "archive_path").select("archive_path", "label", "pixel_sum")


def q_convert_to_archive(spark, sf):
    """The conversion into zip archives, scanned and decoded again."""
    from .prepare import convert_dataset
    dest = MZ.fresh_folder(spark, "converted") + "/images.zip"
    convert_dataset(spark, MZ.write_image_folder(spark, sf), dest, "center-crop-dhariwal", 4, 4)
    found = S.scan_image_archives(spark, dest[:-len(".zip")] + "*.zip")
    files, folder = S.unpack_archives(spark, found)
    back = IM.read_images(spark, folder, "path", recursive=True).select(
        F.regexp_extract("path", r"(\d{8})\.png$", 1).cast("bigint").alias("idx"), _pixel_sum(F.col("image.data")).alias("pixel_sum"))
    return found.join(back, "idx").select(F.col("member").alias("archive_path"), "label", "pixel_sum")


def q_encode_dataset(spark, sf):
    """The encoding flow after conversion: channel mean/std per image written as
    ``img-mean-std-<idx>.npy`` files, read back through the array ingest (S5)."""
    from .prepare import convert_dataset, encode_dataset
    src = MZ.write_image_folder(spark, sf)
    conv = MZ.fresh_folder(spark, "converted")
    convert_dataset(spark, src, conv, "center-crop-dhariwal", 4, 4)
    enc = MZ.fresh_folder(spark, "encoded")
    encode_dataset(spark, conv, enc, SC.channel_moments_encoder(), 6)
    back = S.ingest_arrays(spark, enc + "/*/*.npy")
    return back.select(F.regexp_extract("path", r"img-mean-std-(\d{8})\.npy$", 1).cast("bigint").alias("idx"),
                       rnd(F.element_at("values", 1), 4).alias("mean_r"),
                       rnd(F.element_at("values", 4), 4).alias("std_r"), F.size("values").alias("n"))


def q_train_set(spark, sf):
    """Converted images, their encodings and tokens written by the flows, read back as the training set."""
    from .prepare import convert_dataset, encode_dataset, encode_tokens_dataset, load_training_set
    conv, enc, tok = (MZ.fresh_folder(spark, x) for x in ("converted", "encoded", "tokens"))
    convert_dataset(spark, MZ.write_image_folder(spark, sf), conv, "center-crop-dhariwal", 4, 4)
    encode_dataset(spark, conv, enc, SC.channel_moments_encoder(), 6)
    encode_tokens_dataset(spark, conv, tok, SC.quadrant_token_encoder(), 9, 2)
    t = load_training_set(spark, conv, enc, tok)
    return t.select("idx", "image", "label", rnd(F.element_at("latents", 1), 4).alias("mean_r"), F.size("latents").alias("n"),
                    rnd(F.element_at("cls", 1), 4).alias("cls_0"), rnd(F.element_at("patches", 8), 4).alias("last_patch"),
                    F.element_at("patch_shape", 1).alias("n_patches"))


def q_eval_from_batches(spark, sf):
    """The evaluation from ``.npz`` batches and an extractor; equals ``eval_report``."""
    from .evaluate import REPORT_ORDER, evaluation_from_batches
    ref, smp = (MZ.write_npz_batches(spark, sf, parity=p) for p in (0, 1))

    def make():
        import numpy as np

        def extract(x):
            v = x[:, 1:]
            z = np.exp(20.0 * v[:, :10] - (20.0 * v[:, :10]).max(axis=1, keepdims=True))
            return {"features": v, "spatial": v[:, :32], "probs": z / z.sum(axis=1, keepdims=True)}
        return extract
    nums = evaluation_from_batches(spark, ref, smp, make)
    rows = [(i, name, float(nums[name])) for i, name in enumerate(REPORT_ORDER)]
    return spark.createDataFrame(rows, "metric_order int, metric string, value double").withColumn("value", rnd("value"))


def q_sample_batches(spark, sf):
    """Generation output: decoder values (the embedding) quantised to uint8 pixels
    (G8, truncating form), packed as sharded ``.npz`` sample batches and read
    back with the batch reader (S6)."""
    from ..functions import images as G
    e = fx.table(spark, sf, "embeddings")
    px = G.quantize_pixels(F.col("embedding"), "truncate")
    rgb = F.flatten(F.transform(px, lambda v: F.array(v, v, v)))
    samples = e.select(F.col("vec_id").alias("index"), rgb.alias("pixels"))
    dest = MZ.fresh_folder(spark, "samples")
    W.write_array_batches(samples, dest, shape=(8, 8, 3), rows_per_file=64).agg(F.sum("rows")).collect()
    back = S.ingest_array_batches(spark, dest, "arr_0", batch_size=32)
    first = F.regexp_extract("path", r"samples-(\d+)\.npz$", 1).cast("bigint")
    return back.select((first + F.col("row")).alias("index"),
                       F.aggregate("values", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("pixel_sum"))


def q_encoder_inputs(spark, sf):
    """G7 for one family of each kind, 8 x 8 pixels to 6 x 6 where it resizes: all values, weighted by their place."""
    px = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor((v + 1.0) * 127.5).cast("int"))
    data = F.unhex(F.array_join(F.transform(px, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3)), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    images = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), image.alias("image"))
    out = None
    for family in ("clip", "dinov2", "mae", "other"):
        one = IM.encoder_inputs(images, family, side=6).select(
            "idx", F.lit(family).alias("family"), F.element_at("shape", 2).alias("side"),
            rnd(F.aggregate(F.transform("values", lambda v, i: v * (i % 97 + 1)), F.lit(0.0), lambda a, v: a + v), 3).alias("placed"))
        out = one if out is None else out.unionByName(one)
    return out


def q_transform_box(spark, sf):
    """G5 (dhariwal path: one 2x box halving of 8x8 to 4x4), checked per image sum."""
    root = MZ.write_image_folder(spark, sf)
    imgs = IM.read_images(spark, root + "/*/*.png")
    idx = imgs.select(F.regexp_extract("path", r"img_(\d+)\.png", 1).cast("bigint").alias("idx"), "image")
    out, bad = IM.drop_failed(IM.transform_images(idx, "center-crop-dhariwal", 4, 4))
    return out.select("idx", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                      _pixel_sum(F.col("image.data")).alias("pixel_sum"))


def q_transform_quarantine(spark, sf):
    """G5 + P3: wide crop to 16 x 8 rejects every 8 x 8 image; centre crop keeps all."""
    root = MZ.write_image_folder(spark, sf)
    imgs = IM.read_images(spark, root + "/*/*.png")
    idx = imgs.select(F.regexp_extract("path", r"img_(\d+)\.png", 1).cast("bigint").alias("idx"), "image")
    wide = IM.transform_images(idx, "center-crop-wide", 16, 8)
    crop = IM.transform_images(idx, "center-crop", 4, 4)
    w_ok, w_bad = IM.drop_failed(wide)
    c_ok, c_bad = IM.drop_failed(crop)
    return (w_bad.select(F.lit("wide").alias("mode"), "idx", "error")
            .unionByName(c_ok.select(F.lit("crop").alias("mode"), "idx", F.lit(None).cast("string").alias("error"))))


#: mode -> (width, height) on the 8 x 8 images
PIXEL_MODES = {"scale": (5, 3), "center-crop": (5, 5), "center-crop-wide": (6, 4), "center-crop-dhariwal": (3, 3)}


def q_transform_pixels(spark, sf):
    """G5 on the plans G1-G4: pixels of every mode (Lanczos, and box halving then bicubic),
    each weighted by its place, per image."""
    root = MZ.write_image_folder(spark, sf)
    imgs = IM.read_images(spark, root + "/*/*.png")
    idx = imgs.select(F.regexp_extract("path", r"img_(\d+)\.png", 1).cast("bigint").alias("idx"), "image")
    placed_sum = F.pandas_udf(_placed_sum_impl, "long")
    parts = []
    for mode, (w, h) in PIXEL_MODES.items():
        out, _ = IM.drop_failed(IM.transform_images(idx, mode, w, h))
        parts.append(out.select(F.lit(mode).alias("mode"), "idx", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                                placed_sum("image.data").alias("placed_sum")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def q_scan_archives(spark, sf):
    root = MZ.write_archives(spark, sf)
    a = S.scan_image_archives(spark, root + "/*.zip")
    return a.select(_base("archive").alias("archive"), "member", "idx", "label")


def q_open_dataset(spark, sf):
    root = MZ.write_archives(spark, sf)
    a = S.open_dataset(spark, root + "/*.zip")
    return a.select("member", "idx", "label")


def q_read_manifest(spark, sf):
    root = MZ.write_image_folder(spark, sf, with_manifest=True)
    return L.read_label_manifest(spark, os.path.join(root, "dataset-*.json"))


def q_list_files(spark, sf):
    root = MZ.write_npy_files(spark, sf)
    f = S.list_files(spark, root, ignores=["*_patches.npy", "vec_1?_cls.npy"])
    return f.select("rel_path", "length")


def q_ingest_arrays(spark, sf):
    root = MZ.write_npy_files(spark, sf)
    a = S.ingest_arrays(spark, root + "/*_cls.npy")
    return a.select(F.regexp_extract("path", r"vec_(\d+)_cls", 1).cast("bigint").alias("id"),
                    F.size("values").alias("n"), "dtype", rnd(F.aggregate("values", F.lit(0.0), lambda x, y: x + y))
                    .alias("total"))


def q_ingest_batches(spark, sf):
    root = MZ.write_npz_batches(spark, sf)
    b = S.ingest_array_batches(spark, root, "arr_0", batch_size=32)
    return b.select(F.element_at("values", 1).cast("bigint").alias("id"), F.element_at("shape", 1).alias("width"),
                    rnd(F.aggregate(F.slice("values", 2, 64), F.lit(0.0), lambda x, y: x + y)).alias("total"))


def q_feature_set_files(spark, sf):
    root = MZ.write_npy_files(spark, sf)
    f = S.scan_feature_set(spark, root)
    have = S.list_files(spark, root).select(F.col("path").alias("sibling"))
    missing = f.join(have, "sibling", "left_anti")
    return missing.select(_base("rel_path").alias("cls_file"), "idx")


def q_stats_roundtrip(spark, sf):
    """Save statistics, load them back, same FID as recomputing."""
    ref, smp = fx.ref_features(spark, sf), fx.sample_features(spark, sf)
    folder = MZ.fresh_folder(spark, "stats")
    s_ref = stats.fit_statistics(ref)
    S.save_stats(spark, s_ref, folder + "/ref")
    loaded = S.load_or_compute_stats(ref, folder + "/ref")
    computed = S.load_or_compute_stats(smp, folder + "/missing")
    fid = stats.frechet_distance(computed, loaded)
    return spark.createDataFrame([(round(fid, 6), int(loaded.n))], "fid double, n_ref long")


# ---------------------------------------------------------------- sinks
def q_write_dataset(spark, sf):
    from .q_prep import image_index
    folder = MZ.fresh_folder(spark, "dataset")
    idx = image_index(spark, sf)
    W.write_dataset(idx.select("idx", "path"), folder + "/data")
    back = spark.read.parquet(folder + "/data")
    return back.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("archive_path").alias("first"))


def q_write_manifest(spark, sf):
    from .q_prep import image_index
    folder = MZ.fresh_folder(spark, "manifest")
    idx = image_index(spark, sf).withColumn("archive_path", F.format_string("img%08d.png", "idx"))
    lab = idx.withColumn("label", (F.col("doc_id") % 5).cast("int"))
    W.write_manifest(lab, folder + "/one", documents=True, rows=100)
    W.write_manifest(lab, folder + "/lines")
    doc = spark.read.schema(L.MANIFEST_SCHEMA).json(folder + "/one")
    pairs = doc.select(F.posexplode("labels").alias("pos", "p")).select(
        F.element_at("p", 1).alias("name"), F.element_at("p", 2).cast("int").alias("label"))
    lines = spark.read.schema("name string, label int").json(folder + "/lines")
    return pairs.join(lines.withColumnRenamed("label", "label_lines"), "name", "full")


def q_write_report(spark, sf):
    """The five evaluation numbers written as report lines and read back."""
    from .evaluate import _with_spatial, evaluation_numbers
    folder = MZ.fresh_folder(spark, "report")
    ref = _with_spatial(fx.ref_features(spark, sf))
    smp = _with_spatial(fx.sample_features(spark, sf))
    probs = fx.probs(spark, sf).where(F.pmod("id", F.lit(2)) == 1)
    W.write_eval_report(spark, evaluation_numbers(ref, smp, probs), folder + "/report")
    lines = spark.read.text(folder + "/report")
    return lines.select(F.split("value", ": ").getItem(0).alias("metric"),
                        rnd(F.split("value", ": ").getItem(1).cast("double")).alias("value"))


def q_write_metrics(spark, sf):
    folder = MZ.fresh_folder(spark, "metrics")
    log = M.cross_rank_mean(fx.step_log(spark, sf))
    W.write_metrics(log.where(F.pmod("step", F.lit(2)) == 0), folder + "/m", "run_a")
    W.write_metrics(log.where(F.pmod("step", F.lit(2)) == 1), folder + "/m", "run_b")
    back = spark.read.parquet(folder + "/m")
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scoring
def q_score_batch(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    udf = SC.batch_score(SC.softmax_head(PROB_COLS), T.ArrayType(T.DoubleType()), batch_size=64,
                         input_tensor_shapes=[[64]])
    p = e.select("id", udf("embedding").alias("probs"))
    return p.select("id", F.posexplode("probs").alias("c", "p")).select(
        "id", F.col("c").cast("int").alias("c"), rnd("p").alias("p"))


def q_score_in_pandas(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    head = SC.softmax_head(PROB_COLS)

    def make():
        f = head()
        return lambda x: {"top": f(x).argmax(axis=1).astype("int32"), "p_max": f(x).max(axis=1)}
    s = SC.score_in_pandas(e, make, "embedding", "id long, top int, p_max double", ["id"])
    return s.select("id", "top", rnd("p_max").alias("p_max"))


# ---------------------------------------------------------------- streaming
def q_stream_moments(spark, sf):
    ev = ST.table_stream(spark, sf, "events.parquet")
    reports = fx.metric_reports_from(ev)
    m = ST.upsert_available_now(ST.stream_metric_moments(reports), ["name"], MZ.fresh_folder(spark, "moments") + "/v", "fl_moments")
    return M.metric_summary(m).select("name", "num", rnd("sum", 4).alias("sum"), rnd("sumsq", 2).alias("sumsq"),
                                      rnd("mean").alias("mean"), rnd("std").alias("std"))


def q_stream_window_moments(spark, sf):
    ev = ST.table_stream(spark, sf, "events.parquet")
    reports = fx.metric_reports_from(ev.withColumn("ts", fx.ntz_as_utc("ts")), keep=["ts"])
    agg = ST.stream_window_moments(reports, "ts", "1 day", "2 days")
    agg = agg.select(F.unix_seconds(F.col("window.start")).alias("day_start"), "name", "num", "sum")
    out = ST.upsert_available_now(agg, ["day_start", "name"], MZ.fresh_folder(spark, "win") + "/v", "fl_win")
    return out.select("day_start", "name", "num", rnd("sum", 4).alias("sum"))


def q_stream_step_logs_complete(spark, sf):
    """Four events are one step, one per rank, of three metrics by turns; reported when all four are there."""
    from ..streaming.complete import append_available_now, stream_complete_steps
    ev = ST.table_stream(spark, sf, "events.parquet", max_files=1)
    step = F.floor(F.col("event_id") / 4).cast("bigint")
    reports = ev.select(F.concat(F.lit("m"), F.pmod(step, F.lit(3)).cast("string")).alias("name"), step.alias("step"),
                        F.pmod("event_id", F.lit(4)).alias("rank"), "value")
    out = append_available_now(stream_complete_steps(reports, 4, decay=0.9), MZ.fresh_folder(spark, "complete-steps"), "complete-steps")
    return out.select("name", "step", "n_ranks", "complete", rnd("mean").alias("mean"), rnd("ema").alias("ema"))


def q_stream_step_logs(spark, sf):
    ev = ST.table_stream(spark, sf, "events.parquet")
    log = fx.step_log_from(fx.metric_reports_from(ev))
    agg = ST.stream_step_logs(log, late_steps=1000)
    out = ST.upsert_available_now(agg, ["step", "name"], MZ.fresh_folder(spark, "steps") + "/v", "fl_steps")
    return out.select("step", "name", rnd("mean").alias("mean"), "n_ranks")


def q_stream_features(spark, sf):
    src = ST.table_stream(spark, sf, "embeddings.parquet")
    udf = SC.batch_score(SC.softmax_head(PROB_COLS), T.ArrayType(T.DoubleType()), batch_size=64,
                         input_tensor_shapes=[[64]])
    dest = MZ.fresh_folder(spark, "stream-features") + "/f"
    ST.stream_features(src.select(F.col("vec_id").alias("id"), "embedding"), udf, "embedding", "id", dest,
                       "fl_features")
    man = ST.features_manifest(spark, dest, "id")
    return man.select("id", F.posexplode("features").alias("c", "p")).select(
        "id", F.col("c").cast("int").alias("c"), rnd("p").alias("p"))


def q_stream_images(spark, sf):
    """M2 + G5 + N1: image files streamed, box-halved to 4 x 4, encoded (pixel-sum encoder)."""
    root = MZ.write_image_folder(spark, sf)
    dest = MZ.fresh_folder(spark, "stream-images")
    man = ST.stream_image_features(spark, root, "center-crop-dhariwal", 4, 4, SC.pixel_sum_encoder(), 1,
                                   dest, "fl_stream_images")
    return man.select(_base("path").alias("name"), F.element_at("features", 1).cast("bigint").alias("pixel_sum"))


QUERIES = {
    "io_sample_batches": q_sample_batches,
    "train_set_from_files": q_train_set,
    "eval_from_batches": q_eval_from_batches,
    "io_convert_dataset": q_convert_dataset,
    "io_convert_roundtrip_labels": q_convert_roundtrip,
    "io_convert_quarantine": q_convert_quarantine,
    "io_convert_archive": q_convert_archive,
    "io_convert_to_archive": q_convert_to_archive,
    "io_encode_dataset": q_encode_dataset,
    "io_stream_images": q_stream_images,
    "io_scan_images": q_scan_images,
    "io_scan_images_manifest": q_scan_images_manifest,
    "io_read_pixels": q_read_pixels,
    "prep_encoder_inputs": q_encoder_inputs,
    "io_transform_box": q_transform_box,
    "io_transform_quarantine": q_transform_quarantine,
    "io_transform_pixels": q_transform_pixels,
    "io_scan_archives": q_scan_archives,
    "io_open_dataset": q_open_dataset,
    "io_read_manifest": q_read_manifest,
    "io_list_files": q_list_files,
    "io_ingest_arrays": q_ingest_arrays,
    "io_ingest_batches": q_ingest_batches,
    "io_feature_set_files": q_feature_set_files,
    "io_stats_roundtrip": q_stats_roundtrip,
    "io_write_dataset": q_write_dataset,
    "io_write_manifest": q_write_manifest,
    "io_write_report": q_write_report,
    "io_write_metrics": q_write_metrics,
    "score_batch": q_score_batch,
    "score_in_pandas": q_score_in_pandas,
    "stream_moments": q_stream_moments,
    "stream_window_moments": q_stream_window_moments,
    "stream_step_logs": q_stream_step_logs,
    "stream_step_logs_complete": q_stream_step_logs_complete,
    "stream_features": q_stream_features,
}

# ---------------------------------------------------------------- oracles
_PX = "list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(floor((v + 1.0) * 127.5) AS BIGINT))"


def _encoder_inputs_sql() -> str:
    """Cubic interpolation (a = -0.75, four taps, border repeated) from 8 to 6, and the channels' statistics."""
    from ..functions.images import CLIP_MEAN, CLIP_STD, IMAGENET_MEAN, IMAGENET_STD
    stats = ", ".join(f"('{f}', {c}, {m!r}::DOUBLE, {s!r}::DOUBLE)" for f, mean, std in (
        ("clip", CLIP_MEAN, CLIP_STD), ("dinov2", IMAGENET_MEAN, IMAGENET_STD), ("mae", IMAGENET_MEAN, IMAGENET_STD)) for c, (m, s) in enumerate(zip(mean, std)))
    return f"""WITH st(family, c, mean, std) AS (VALUES {stats}),
t AS (SELECT o, least(greatest(f + k, 0), 7) AS i, abs(f + k - src) AS x
      FROM (SELECT o, (o + 0.5::DOUBLE) * 8 / 6 - 0.5 AS src, floor((o + 0.5::DOUBLE) * 8 / 6 - 0.5) AS f FROM range(0, 6) r(o)), range(-1, 3) s(k)),
w AS (SELECT o, i, sum(CASE WHEN x < 1 THEN (1.25 * x - 2.25) * x * x + 1 WHEN x < 2 THEN -0.75 * (((x - 5) * x + 8) * x - 4) ELSE 0 END) AS w FROM t GROUP BY o, i),
p AS (SELECT vec_id AS idx, {_PX} AS px FROM embeddings),
g AS (SELECT idx, yy, xx, px[yy * 8 + xx + 1]::DOUBLE AS v FROM p, range(0, 8) a(yy), range(0, 8) b(xx)),
z AS (SELECT idx, a.o AS oy, b.o AS ox, sum(v * a.w * b.w) AS v FROM g JOIN w a ON a.i = yy JOIN w b ON b.i = xx GROUP BY idx, a.o, b.o),
n AS (SELECT idx, family, 6 AS side, c * 36 + oy * 6 + ox AS place, (v / 255 - mean) / std AS v FROM z, st WHERE family <> 'mae'
      UNION ALL SELECT idx, family, 8, c * 64 + yy * 8 + xx, (v / 255 - mean) / std FROM g, st WHERE family = 'mae'
      UNION ALL SELECT idx, 'other', 8, c * 64 + yy * 8 + xx, v FROM g, range(0, 3) r(c))
SELECT idx, family, side::INTEGER AS side, round0(sum(v * (place % 97 + 1)), 3) AS placed FROM n GROUP BY idx, family, side"""


def _pixels_sql() -> str:
    """Every mode: source pixels -> weights along rows and columns -> rounded pixels weighted by their place."""
    cells = f"SELECT vec_id AS idx, y, x, px[y * 8 + x + 1]::DOUBLE AS v FROM (SELECT vec_id, {_PX} AS px FROM embeddings), range(0, 8) a(y), range(0, 8) b(x)"
    even = lambda e: f"round_even({e}, 0)"

    def resized(source, wx, wy):
        return (f"SELECT s.idx, wy.o AS y, wx.o AS x, least(greatest({even('sum(s.v * wx.w * wy.w)')}, 0), 255) AS v "
                f"FROM {source} s JOIN {wx} wx ON wx.i = s.x JOIN {wy} wy ON wy.i = s.y GROUP BY s.idx, wy.o, wx.o")

    def placed(mode, table, width, height, top=0):
        return (f"SELECT '{mode}' AS mode, idx, CAST({height} AS INTEGER) AS height, CAST({width} AS INTEGER) AS width, "
                f"CAST(sum(v * ((y + {top}) * {width} + x + 1)) AS BIGINT) AS placed_sum FROM {table} GROUP BY idx")
    return ("WITH " + ", ".join([
        resample_sql("l85", 8, 5, "lanczos"), resample_sql("l83", 8, 3, "lanczos"), resample_sql("l86", 8, 6, "lanczos"),
        resample_sql("l64", 6, 4, "lanczos"), resample_sql("b43", 4, 3, "bicubic"),
        f"src AS MATERIALIZED ({cells})", "mid AS (SELECT idx, y - 1 AS y, x, v FROM src WHERE y BETWEEN 1 AND 6)",
        f"half AS (SELECT idx, y // 2 AS y, x // 2 AS x, {even('avg(v)')} AS v FROM src GROUP BY idx, y // 2, x // 2)",
        f"o1 AS ({resized('src', 'l85', 'l83')})", f"o2 AS ({resized('src', 'l85', 'l85')})",
        f"o3 AS ({resized('mid', 'l86', 'l64')})", f"o4 AS ({resized('half', 'b43', 'b43')})"])
        + "\n" + " UNION ALL ".join([placed("scale", "o1", 5, 3), placed("center-crop", "o2", 5, 5),
                                     placed("center-crop-wide", "o3", 6, 6, 1), placed("center-crop-dhariwal", "o4", 3, 3)]))


#: the converted images of the folder fixture
_CONVERTED_SQL = f"""WITH p AS (SELECT vec_id, label, {_PX} AS px,
    'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png' AS rel FROM embeddings),
i AS (SELECT *, row_number() OVER (ORDER BY rel) - 1 AS idx FROM p),
c AS (SELECT top, CAST(row_number() OVER (ORDER BY top) - 1 AS INTEGER) AS cls
      FROM (SELECT DISTINCT 'class_' || CAST(label AS VARCHAR) AS top FROM embeddings)),
b AS (SELECT idx, yy, xx, round_even((px[(2*yy)*8 + 2*xx + 1] + px[(2*yy)*8 + 2*xx + 2]
                     + px[(2*yy+1)*8 + 2*xx + 1] + px[(2*yy+1)*8 + 2*xx + 2]) / 4.0, 0) AS v
      FROM i, range(0, 4) r(yy), range(0, 4) s(xx)),
t AS (SELECT idx, CAST(3 * sum(v) AS BIGINT) AS pixel_sum FROM b GROUP BY idx)
SELECT substr(printf('%08d', i.idx), 1, 5) || '/img' || printf('%08d', i.idx) || '.png' AS archive_path,
       c.cls AS label, t.pixel_sum
FROM i JOIN t USING (idx) JOIN c ON c.top = 'class_' || CAST(i.label AS VARCHAR)"""

ORACLES = {
    "prep_encoder_inputs": _encoder_inputs_sql(),
    "io_transform_pixels": _pixels_sql(),
    "io_sample_batches": """SELECT vec_id AS "index",
  CAST(3 * list_sum(list_transform(CAST(embedding AS DOUBLE[]),
       lambda v: floor(least(greatest((v + 1.0) / 2.0 * 255.0, 0.0), 255.0)))) AS BIGINT) AS pixel_sum
FROM embeddings""",
    "io_convert_dataset": _CONVERTED_SQL,
    "io_convert_to_archive": _CONVERTED_SQL,
    "train_set_from_files": f"""WITH p AS (SELECT vec_id, label, {_PX} AS px,
    'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png' AS rel FROM embeddings),
i AS (SELECT *, row_number() OVER (ORDER BY rel) - 1 AS idx, dense_rank() OVER (ORDER BY 'class_' || CAST(label AS VARCHAR)) - 1 AS cls FROM p),
b AS (SELECT idx, cls, yy, xx, round_even((px[(2*yy)*8 + 2*xx + 1] + px[(2*yy)*8 + 2*xx + 2]
                     + px[(2*yy+1)*8 + 2*xx + 1] + px[(2*yy+1)*8 + 2*xx + 2]) / 4.0, 0) AS v
      FROM i, range(0, 4) r(yy), range(0, 4) s(xx))
SELECT idx, substr(printf('%08d', idx), 1, 5) || '/img' || printf('%08d', idx) || '.png' AS image, CAST(max(cls) AS INTEGER) AS label,
  round0(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 4) AS mean_r, 6 AS n, round0(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 4) AS cls_0,
  round0(max(v) FILTER (WHERE yy = 3 AND xx = 3), 4) AS last_patch, 4 AS n_patches FROM b GROUP BY idx""",
    "io_convert_roundtrip_labels": """WITH f AS (SELECT 'class_' || CAST(label AS VARCHAR) AS top,
    'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) || '.png' AS rel
    FROM embeddings, range(0, 3) c(k)),
i AS (SELECT *, row_number() OVER (ORDER BY rel) - 1 AS idx, dense_rank() OVER (ORDER BY top) - 1 AS cls FROM f)
SELECT substr(printf('%08d', idx), 1, 5) || '/img' || printf('%08d', idx) || '.png' AS rel_path, idx, CAST(cls AS INTEGER) AS label FROM i""",
    "io_convert_quarantine": """WITH i AS (SELECT vec_id, row_number() OVER (
    ORDER BY 'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png') - 1 AS idx FROM embeddings)
SELECT idx, CASE WHEN vec_id % 10 <> 3 THEN CAST(3 AS INTEGER) END AS channels,
  CASE WHEN vec_id % 10 = 3 THEN 'missing or undecodable image' END AS error FROM i""",
    "io_convert_archive": f"""WITH p AS (SELECT vec_id, {_PX} AS px,
    'label_' || CAST(label AS VARCHAR) || '_' || CAST(vec_id % 2 AS VARCHAR) || '.zip' AS archive, 'img_' || CAST(vec_id AS VARCHAR) || '.png' AS member
    FROM embeddings),
i AS (SELECT *, row_number() OVER (ORDER BY archive, member) - 1 AS idx FROM p),
b AS (SELECT idx, round_even((px[(2*yy)*8 + 2*xx + 1] + px[(2*yy)*8 + 2*xx + 2]
                     + px[(2*yy+1)*8 + 2*xx + 1] + px[(2*yy+1)*8 + 2*xx + 2]) / 4.0, 0) AS v
      FROM i, range(0, 4) r(yy), range(0, 4) s(xx)),
t AS (SELECT idx, CAST(3 * sum(v) AS BIGINT) AS pixel_sum FROM b GROUP BY idx)
SELECT substr(printf('%08d', idx), 1, 5) || '/img' || printf('%08d', idx) || '.png' AS archive_path,
       CAST(vec_id % 3 AS INTEGER) AS label, pixel_sum FROM i JOIN t USING (idx)""",
    "io_encode_dataset": f"""WITH p AS (SELECT vec_id, {_PX} AS px,
    'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png' AS rel FROM embeddings),
i AS (SELECT *, row_number() OVER (ORDER BY rel) - 1 AS idx FROM p),
b AS (SELECT idx, round_even((px[(2*yy)*8 + 2*xx + 1] + px[(2*yy)*8 + 2*xx + 2]
                     + px[(2*yy+1)*8 + 2*xx + 1] + px[(2*yy+1)*8 + 2*xx + 2]) / 4.0, 0) AS v
      FROM i, range(0, 4) r(yy), range(0, 4) s(xx))
SELECT idx, round0(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 4) AS mean_r,
       round0(CAST(CAST(stddev_pop(v) AS FLOAT) AS DOUBLE), 4) AS std_r, 6 AS n
FROM b GROUP BY idx""",
    "io_stream_images": f"""WITH p AS (SELECT vec_id AS idx, {_PX} AS px FROM embeddings),
b AS (SELECT idx, yy, xx, round_even((px[(2*yy)*8 + 2*xx + 1] + px[(2*yy)*8 + 2*xx + 2]
                     + px[(2*yy+1)*8 + 2*xx + 1] + px[(2*yy+1)*8 + 2*xx + 2]) / 4.0, 0) AS v
      FROM p, range(0, 4) r(yy), range(0, 4) s(xx))
SELECT 'img_' || CAST(idx AS VARCHAR) || '.png' AS name, CAST(3 * sum(v) AS BIGINT) AS pixel_sum FROM b GROUP BY idx""",
    "io_scan_images": """WITH f AS (SELECT 'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png' AS rel_path,
    'class_' || CAST(label AS VARCHAR) AS top FROM embeddings),
c AS (SELECT top, CAST(row_number() OVER (ORDER BY top) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT top FROM f))
SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS idx,
       CASE WHEN (SELECT count(*) FROM c) > 1 THEN c.label END AS label FROM f JOIN c USING (top)""",
    "io_scan_images_manifest": """SELECT rel_path, idx, label FROM (
  SELECT 'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png' AS rel_path,
         row_number() OVER (ORDER BY 'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png') - 1 AS idx,
         CAST(vec_id % 7 AS INTEGER) AS label FROM embeddings)""",
    "io_read_pixels": f"""SELECT 'img_' || CAST(vec_id AS VARCHAR) || '.png' AS name, 8 AS height, 8 AS width,
  CAST(3 * list_sum({_PX}) AS BIGINT) AS pixel_sum FROM embeddings""",
    "io_transform_box": f"""WITH p AS (SELECT vec_id AS idx, {_PX} AS px FROM embeddings),
b AS (SELECT idx, yy, xx, round_even((px[(2*yy)*8 + 2*xx + 1] + px[(2*yy)*8 + 2*xx + 2]
                     + px[(2*yy+1)*8 + 2*xx + 1] + px[(2*yy+1)*8 + 2*xx + 2]) / 4.0, 0) AS v
      FROM p, range(0, 4) r(yy), range(0, 4) s(xx))
SELECT idx, 4 AS height, 4 AS width, CAST(3 * sum(v) AS BIGINT) AS pixel_sum FROM b GROUP BY idx""",
    "io_transform_quarantine": """SELECT 'wide' AS mode, vec_id AS idx, 'rejected' AS error FROM embeddings
UNION ALL SELECT 'crop', vec_id, NULL FROM embeddings""",
    "io_scan_archives": """SELECT archive, member, row_number() OVER (ORDER BY archive, member) - 1 AS idx, label FROM (
  SELECT 'label_' || CAST(label AS VARCHAR) || '_' || CAST(vec_id % 2 AS VARCHAR) || '.zip' AS archive,
         'img_' || CAST(vec_id AS VARCHAR) || '.png' AS member, CAST(vec_id % 3 AS INTEGER) AS label FROM embeddings)""",
    "io_open_dataset": """SELECT member, row_number() OVER (ORDER BY archive, member) - 1 AS idx, label FROM (
  SELECT 'label_' || CAST(label AS VARCHAR) || '_' || CAST(vec_id % 2 AS VARCHAR) || '.zip' AS archive,
         'img_' || CAST(vec_id AS VARCHAR) || '.png' AS member, CAST(vec_id % 3 AS INTEGER) AS label FROM embeddings)""",
    "io_read_manifest": """SELECT 'class_' || CAST(label AS VARCHAR) || '/img_' || CAST(vec_id AS VARCHAR) || '.png' AS name,
  CAST(vec_id % 7 AS INTEGER) AS label FROM embeddings""",
    "io_list_files": """SELECT 'vec_' || CAST(vec_id AS VARCHAR) || '_cls.npy' AS rel_path, CAST(128 + 64 * 4 AS BIGINT) AS length
FROM embeddings WHERE NOT regexp_full_match('vec_' || CAST(vec_id AS VARCHAR) || '_cls.npy', 'vec_1._cls\\.npy')""",
    "io_ingest_arrays": """SELECT vec_id AS id, 64 AS n, 'float32' AS dtype, round0(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM embeddings""",
    "io_ingest_batches": """SELECT vec_id AS id, 65 AS width, round0(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
    "io_feature_set_files": """SELECT 'vec_' || CAST(vec_id AS VARCHAR) || '_cls.npy' AS cls_file,
  idx FROM (SELECT vec_id, row_number() OVER (ORDER BY 'vec_' || CAST(vec_id AS VARCHAR) || '_cls.npy') - 1 AS idx
  FROM embeddings) WHERE vec_id % 11 = 0""",
    "io_write_dataset": """WITH i AS (SELECT row_number() OVER (ORDER BY path) - 1 AS idx FROM (
  SELECT CASE WHEN doc_id % 17 = 0 THEN '' ELSE source || '/' END || 'img_' || CAST(doc_id AS VARCHAR) || '.' ||
       CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'npy' ELSE 'txt' END AS path
  FROM documents) WHERE lower(string_split(path, '.')[-1]) IN ('png', 'jpg', 'jpeg'))
SELECT CAST(substr(printf('%08d', idx), 1, 5) AS INTEGER) AS prefix, count(*) AS n,
  min(substr(printf('%08d', idx), 1, 5) || '/img' || printf('%08d', idx) || '.png') AS first FROM i GROUP BY 1""",
    "io_write_manifest": """WITH i AS (SELECT row_number() OVER (ORDER BY path) - 1 AS idx, doc_id FROM (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE source || '/' END || 'img_' || CAST(doc_id AS VARCHAR) || '.' ||
       CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'npy' ELSE 'txt' END AS path
  FROM documents) WHERE lower(string_split(path, '.')[-1]) IN ('png', 'jpg', 'jpeg'))
SELECT printf('img%08d.png', idx) AS name, CAST(doc_id % 5 AS INTEGER) AS label, CAST(doc_id % 5 AS INTEGER) AS label_lines
FROM i""",
    "io_write_metrics": """SELECT CASE WHEN s % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS run, count(*) AS n
FROM (SELECT DISTINCT event_id // 8 AS s, event_type FROM events) GROUP BY 1""",
    "score_batch": f"""SELECT id, CAST(c - 1 AS INTEGER) AS c, round0(probs[c], 6) AS p FROM ({fx.PROBS_SQL}), range(1, 11) t(c)""",
    "score_in_pandas": f"""SELECT id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS top,
  round0(list_max(probs), 6) AS p_max FROM ({fx.PROBS_SQL})""",
    "stream_window_moments": f"""SELECT CAST(epoch(date_trunc('day', e.ts)) AS BIGINT) AS day_start, r.name, count(*) FILTER (WHERE r.value * r.value < 3.4028235677973366e38) AS num,
  round0(coalesce(sum(r.value) FILTER (WHERE r.value * r.value < 3.4028235677973366e38), 0.0), 4) AS sum
FROM ({fx.METRIC_REPORTS_SQL}) r JOIN events e USING (event_id) GROUP BY 1, 2""",
    "stream_features": f"""SELECT id, CAST(c - 1 AS INTEGER) AS c, round0(probs[c], 6) AS p FROM ({fx.PROBS_SQL}), range(1, 11) t(c)""",
}


def _late_oracles():
    from .q_evaluate import REPORT_SQL
    from .sqltext import frechet_sql
    ORACLES["eval_from_batches"] = REPORT_SQL.format(columns="CAST(o AS INTEGER) AS metric_order, metric, value")
    ORACLES["io_write_report"] = REPORT_SQL.format(columns="metric, value")
    ORACLES["io_stats_roundtrip"] = "WITH RECURSIVE " + frechet_sql("f", 64) + """
SELECT round0(fid, 6) AS fid, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS n_ref FROM fid_f"""
    from .q_metrics import CROSS_RANK_SQL, MOMENTS_SQL
    ORACLES["stream_moments"] = MOMENTS_SQL
    ORACLES["stream_step_logs"] = CROSS_RANK_SQL
    ORACLES["stream_step_logs_complete"] = """WITH RECURSIVE
m AS (SELECT 'm' || ((event_id // 4) % 3)::VARCHAR AS name, event_id // 4 AS step, count(DISTINCT event_id % 4) AS n, avg(value) AS mean
      FROM events WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT event_id % 4) = 4),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) AS k FROM m),
e(name, step, n, mean, k, ema) AS (
  SELECT name, step, n, mean, k, mean FROM o WHERE k = 1
  UNION ALL SELECT o.name, o.step, o.n, o.mean, o.k, 0.9::DOUBLE * e.ema + (1 - 0.9::DOUBLE) * o.mean FROM e JOIN o ON o.name = e.name AND o.k = e.k + 1)
SELECT name, step, n::INTEGER AS n_ranks, true AS complete, round0(mean, 6) AS mean, round0(ema, 6) AS ema FROM e"""


_late_oracles()
