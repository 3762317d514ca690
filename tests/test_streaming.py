"""Stream results equal batch results after an available-now run (M1, M3)."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from featurelab.operators import metrics as M
from featurelab.plans import fixtures as fx
from featurelab.streaming import jobs as ST


@pytest.mark.parametrize("folder", [False, True])
def test_stream_moments_equal_batch(spark, tmp_path, folder):
    """The table may be one file or a folder of files."""
    sf = SF_SMALL
    if folder:
        sf = str(tmp_path / "sf")
        spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(f"{sf}/events.parquet")
    ev = ST.table_stream(spark, sf, "events.parquet")
    got = ST.upsert_available_now(ST.stream_metric_moments(fx.metric_reports_from(ev)), ["name"], str(tmp_path / "v"), "t_stream_mom")
    want = M.metric_moments(fx.metric_reports(spark, SF_SMALL))
    g = {r["name"]: (r["num"], round(r["sum"], 6)) for r in got.collect()}
    w = {r["name"]: (r["num"], round(r["sum"], 6)) for r in want.collect()}
    assert g == w


def test_stream_step_logs_equal_batch(spark, tmp_path):
    ev = ST.table_stream(spark, SF_SMALL, "events.parquet", max_files=1)
    log = fx.step_log_from(fx.metric_reports_from(ev))
    out = ST.upsert_available_now(ST.stream_step_logs(log), ["step", "name"], str(tmp_path / "v"), "t_steps")
    want = M.cross_rank_mean(fx.step_log(spark, SF_SMALL))
    assert out.count() == want.count()
    diff = out.join(want.withColumnRenamed("mean", "m2").withColumnRenamed("n_ranks", "n2"), ["step", "name"])
    bad = diff.where(~(F.col("mean").eqNullSafe(F.col("m2")) | (F.abs(F.col("mean") - F.col("m2")) < 1e-9)))
    assert bad.count() == 0


def test_step_logs_drop_late_ranks(spark, tmp_path):
    """Resumed stream: a rank reporting for a step older than the watermark is
    dropped; a step within the tolerated lag is still updated."""
    src = tmp_path / "src"
    schema = "step long, name string, value double"
    spark.createDataFrame([(s, "loss", 1.0) for s in range(100, 201)], schema).coalesce(1) \
        .write.parquet(str(src / "a"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        return ST.upsert_available_now(ST.stream_step_logs(stream, late_steps=5), ["step", "name"],
                                       str(tmp_path / "v"), "t_late", checkpoint=str(tmp_path / "ck"))

    first = run().toPandas().set_index("step")
    assert len(first) == 101
    spark.createDataFrame([(10, "loss", 99.0), (199, "loss", 3.0)], schema).coalesce(1) \
        .write.parquet(str(src / "b"))
    out = run().toPandas().set_index("step")
    assert 10 not in out.index                      # late: the watermark is 200 - 5
    assert out.loc[199, "n_ranks"] == 2 and out.loc[199, "mean"] == 2.0
    assert out.loc[150, "n_ranks"] == 1


def test_window_moments_append_closes_windows(spark, tmp_path):
    """Append mode emits a day's moments only after the watermark passes it."""
    import datetime as dt
    src = tmp_path / "src"
    schema = "ts timestamp, name string, value double"
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([(day(1, 1), "loss", 1.0), (day(1, 5), "loss", 3.0), (day(2, 1), "loss", 5.0)], schema) \
        .coalesce(1).write.parquet(str(src / "a"))
    out = tmp_path / "out"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        agg = ST.stream_window_moments(stream, "ts", "1 day", "1 day")
        q = (agg.select("window.start", "name", "num", "sum").writeStream.outputMode("append")
             .format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return {(r["start"].day, r["num"], r["sum"]) for r in spark.read.parquet(str(out)).collect()}

    run()  # watermark reaches day 1 only: no window is complete yet
    spark.createDataFrame([(day(5, 1), "loss", 7.0)], schema).coalesce(1).write.parquet(str(src / "b"))
    got = run()  # the watermark moves to day 4: days 1 and 2 are final
    assert got == {(1, 2, 4.0), (2, 1, 5.0)}


def test_restarted_feature_stream_encodes_nothing_twice(spark, tmp_path):
    src, dest, ckpt = (str(tmp_path / x) for x in ("src", "dest", "ckpt"))
    calls = spark.sparkContext.accumulator(0)

    def more(a, b):
        spark.range(a, b).selectExpr("id", "cast(id as double) as x").coalesce(1).write.mode("append").parquet(src)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        calls.add(len(x))
        return x * 2

    def run():
        stream = spark.readStream.schema("id long, x double").parquet(src)
        ST.stream_features(stream, score, "x", "id", dest, "t_restart", checkpoint=ckpt)
        return {r["id"]: r["features"] for r in ST.features_manifest(spark, dest, "id").collect()}

    more(0, 10)
    assert run() == {i: 2.0 * i for i in range(10)} and calls.value == 10
    more(10, 14)
    assert run() == {i: 2.0 * i for i in range(14)} and calls.value == 14


def test_image_stream_leaves_no_staged_pixels(spark, tmp_path):
    import glob

    from featurelab.operators import scoring as SC
    from featurelab.session import ensure_checkpoint_dir
    from featurelab.sinks.writers import png_bytes
    for i in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.png").write_bytes(png_bytes(bytes([30 * i]) * (8 * 8 * 3), 8, 8, 3))
    out = ST.stream_image_features(spark, str(tmp_path / "in"), "center-crop", 4, 4, SC.channel_moments_encoder(), 6, str(tmp_path / "out"), "t_images",
                                   max_files=1)
    assert out.count() == 5 and len(glob.glob(str(tmp_path / "out" / "features" / "batch=*"))) == 5
    assert not glob.glob(ensure_checkpoint_dir(spark).replace("file:", "") + "/staged/stream-images*")


def test_complete_steps_wait_for_every_rank(spark, tmp_path):
    """Restarts keep the state; a step in doubt holds later ones back; a lost rank is given up once the watermark has passed."""
    from featurelab.streaming.complete import append_available_now, stream_complete_steps
    schema = "name string, step long, rank int, value double"
    src = tmp_path / "src"

    def put(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        out = append_available_now(stream_complete_steps(stream, 2, late_steps=3, decay=0.5), str(tmp_path / "out"), "t_complete", str(tmp_path / "ck"))
        return {(r["name"], r["step"]): (r["mean"], r["n_ranks"], r["complete"], r["ema"]) for r in out.collect()}

    def waiting():
        return spark.read.format("statestore").option("stateVarName", "pending").load(str(tmp_path / "ck")).count()

    put([("a", s, r, float(s + r)) for s in range(5) for r in range(2) if (s, r) != (3, 1)] + [("b", 2, 0, 7.0), (None, 1, 0, 1.0), ("a", 1, None, 1.0)], "0")
    first = run()
    assert first == {("a", 0): (0.5, 2, True, 0.5), ("a", 1): (1.5, 2, True, 1.0), ("a", 2): (2.5, 2, True, 1.75)} and waiting() == 3
    put([("a", 3, 1, 4.0), ("a", 3, 1, 99.0), ("a", 0, 1, 5.0), ("a", 5, 0, 1.0)], "1")
    second = run()
    # step 5 less 3 has passed step 2: the other rank of b is given up
    assert second == first | {("a", 3): (3.5, 2, True, 2.625), ("a", 4): (4.5, 2, True, 3.5625), ("b", 2): (7.0, 1, False, 7.0)}
    put([("a", 20, 0, 1.0), ("a", 20, 1, 3.0), ("b", 20, 1, 1.0), ("b", 20, 0, 1.0)], "2")
    third = run()
    assert third == second | {("a", 5): (1.0, 1, False, 2.28125), ("a", 20): (2.0, 2, True, 2.140625), ("b", 20): (1.0, 2, True, 4.0)}
    assert waiting() == 0
    put([("a", 5, 1, 50.0), ("a", 20, 1, 9.0)], "3")
    assert run() == third
