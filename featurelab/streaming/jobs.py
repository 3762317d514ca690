"""M1-M3: metric moments, step logs and encoding as Structured Streaming jobs.

Every job takes ``checkpoint``: a stable folder on shared storage.  Starting
the job again with the same folder resumes it - new files only, state and
batch numbers kept - so nothing is encoded or counted twice.  Without one (a
single run, as in the registered queries) a fresh folder under the session's
``spark.checkpoint.dir`` is used, and a restart begins anew.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import is_finite_report, summary_columns
from ..session import ensure_checkpoint_dir


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Table ``folder/name`` as a stream, stored as one Parquet file or as a folder of
    them (schema from a batch read).  ``name`` may hold wildcards."""
    path = f"{folder.rstrip('/')}/{name}"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    # a stream source names a folder or a glob: the last letter as a class matches just this name
    return r.parquet(path if any(c in name for c in "*?[{") else f"{path[:-1]}[{path[-1]}]")


def stream_metric_moments(stream: DataFrame, keys=("name",), value_col: str = "value") -> DataFrame:
    """M1: running ``num / sum / sumsq`` per key (constant-size state per key)."""
    v = F.col(value_col).cast("double")
    ok = is_finite_report(v)
    return (stream.groupBy(*keys)
            .agg(F.count_if(ok).alias("num"),
                 F.coalesce(F.sum(F.when(ok, v)), F.lit(0.0)).alias("sum"),
                 F.coalesce(F.sum(F.when(ok, v * v)), F.lit(0.0)).alias("sumsq")))


def stream_window_moments(stream: DataFrame, ts_col: str, window: str, delay: str,
                          keys=("name",), value_col: str = "value") -> DataFrame:
    """M1, between-updates form: moments per tumbling event-time window and key;
    the watermark bounds state and closes windows (append mode)."""
    w = stream.withWatermark(ts_col, delay)
    return stream_metric_moments(w.withColumn("window", F.window(ts_col, window)), ("window",) + tuple(keys),
                                 value_col)


def upsert_available_now(df: DataFrame, keys: list[str], dest: str, name: str,
                         checkpoint: str | None = None) -> DataFrame:
    """Run an update-mode aggregate over what is available; each micro-batch's
    changed rows go to ``dest`` with their batch id; the result is the latest
    row per key.  Passing the same ``checkpoint`` again resumes the stream
    (new files only, state and watermark kept)."""
    spark = df.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay: a retried batch is idempotent
        batch.withColumn("_batch", F.lit(int(batch_id))).write.mode("overwrite").parquet(f"{dest}/batch={batch_id}")

    q = (df.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint or checkpoint_path(spark, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    versions = spark.read.parquet(dest).drop("batch")
    others = [c for c in versions.columns if c not in keys and c != "_batch"]
    latest = versions.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])


def stream_step_logs(stream: DataFrame, late_steps: int = 1000, step_col: str = "step",
                     name_col: str = "name", value_col: str = "value") -> DataFrame:
    """M3: mean over ranks per (step, metric) as ranks report.

    The step is the event time (``timestamp_seconds(step)``) and the watermark
    tolerates ``late_steps`` steps of lag: state of older steps is evicted and
    a rank reporting for such a step is dropped (our choice; the source waits
    for every rank).  The watermark column is a grouping key, which is what
    makes Spark evict state and drop late rows.
    """
    # step s is event time s + 1 s: the initial watermark (epoch 0) would treat step 0 as late
    ev = stream.withColumn("_fl_step_ts", F.timestamp_seconds(F.col(step_col) + 1))
    return (ev.withWatermark("_fl_step_ts", f"{int(late_steps)} seconds")
            .groupBy("_fl_step_ts", name_col)
            .agg(F.avg(value_col).alias("mean"), F.count(F.lit(1)).alias("n_ranks"))
            .select((F.unix_seconds("_fl_step_ts") - 1).alias(step_col), name_col, "mean", "n_ranks"))


def stream_features(stream: DataFrame, score_udf, input_col: str, key_col: str, dest: str, name: str,
                    checkpoint: str | None = None) -> None:
    """M2: encode new rows once each as they arrive (N1 inside ``foreachBatch``),
    appending ``(key, features, batch)`` to Parquet; exactly-once progress comes
    from the checkpoint and the idempotent per-batch folder."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(key_col, score_udf(F.col(input_col)).alias("features"))
         .withColumn("_batch", F.lit(int(batch_id)))
         .write.mode("overwrite").parquet(f"{dest}/batch={batch_id}"))

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or checkpoint_path(spark, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def features_manifest(spark: SparkSession, dest: str, key_col: str) -> DataFrame:
    """M2 end: the ordered manifest of everything encoded so far (first encoding wins)."""
    d = spark.read.parquet(dest)
    return (d.groupBy(key_col).agg(F.min_by(F.struct("features", "_batch"), "_batch").alias("_f"))
            .select(key_col, F.col("_f.features").alias("features")))


def moments_summary(df: DataFrame) -> DataFrame:
    return df.select("*", *summary_columns())


def stream_image_features(spark: SparkSession, folder: str, mode: str | None, width: int | None,
                          height: int | None, make_encoder, dim: int, dest: str, name: str,
                          checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """M2 from image files (``max_files`` a micro-batch): new files are decoded (Spark's image source),
    cropped and resampled (G5, failures quarantined), encoded once each (N1)
    and appended per micro-batch; returns the ordered manifest ``(path, features)``."""
    from pyspark.ml.image import ImageSchema

    from ..operators.images import IMAGE_STRUCT, drop_failed, from_spark_image, transform_images
    from ..operators.scoring import encode_images
    from ..session import fewer_scan_tasks, staged

    reader = spark.readStream.format("image").schema(ImageSchema.imageSchema).option("recursiveFileLookup", "true")
    src = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)

    def sink(batch: DataFrame, batch_id: int) -> None:
        imgs = batch.select(F.col("image.origin").alias("path"),
                            F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                                     F.col("image.nChannels").alias("nChannels"),
                                     F.col("image.data").alias("data")).alias("image"))
        rgb = fewer_scan_tasks(imgs).mapInPandas(from_spark_image("image"), f"path string, image {IMAGE_STRUCT}")
        # staged for the length of the batch: the transform runs once for the encoder and the quarantine
        with staged(transform_images(rgb, mode, width, height, key_col="path"), "stream-images") as images:
            good, bad = drop_failed(images)
            (encode_images(good, make_encoder, "path", dim).withColumn("_batch", F.lit(int(batch_id)))
             .write.mode("overwrite").parquet(f"{dest}/features/batch={batch_id}"))
            bad.write.mode("overwrite").parquet(f"{dest}/quarantine/batch={batch_id}")

    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or checkpoint_path(spark, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return features_manifest(spark, f"{dest}/features", "path").orderBy("path")
