"""Property and edge checks: positions, scans, metrics, labels, images, sampling."""
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from featurelab.functions import images as G
from featurelab.functions import paths as P
from featurelab.operators import images as IM
from featurelab.operators import labels as L
from featurelab.operators import metrics as M
from featurelab.operators import sampling as S
from featurelab.operators.position import with_position
from featurelab.operators.scan import linear_scan
from featurelab.plans import fixtures as fx


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_with_position_dense_and_ordered(spark, parts):
    df = fx.table(spark, SF_SMALL, "orders").select("o_orderkey").repartition(parts)
    got = with_position(df, "o_orderkey", "pos", num_partitions=parts).toPandas().sort_values("o_orderkey")
    assert got["pos"].tolist() == list(range(len(got)))


@pytest.mark.parametrize("kind", ["long", "string", "double", "date", "timestamp", "decimal(20,3)", "binary", "boolean"])
def test_positions_follow_the_order_of_every_key_type(spark, kind):
    rows = [(int(v), int(v) % 7 == 0) for v in np.random.default_rng(5).permutation(900)]
    df = spark.createDataFrame(rows, "u long, none boolean").select(
        "u", F.when(~F.col("none"), {"date": F.date_add(F.lit("2000-01-01").cast("date"), F.pmod("u", F.lit(50)).cast("int")),
                                     "timestamp": F.timestamp_seconds(F.pmod("u", F.lit(50)) * 3600.5), "boolean": F.col("u") % 2 == 0,
                                     "double": F.when(F.col("u") % 5 == 0, float("nan")).otherwise(F.pmod("u", F.lit(50)) / 7 - 3)}
                            .get(kind, F.concat(F.lit("é\u0000" if kind in ("string", "binary") else ""), F.pmod("u", F.lit(50)).cast("string")))
                            .cast(kind)).alias("k"))
    want = [r["u"] for r in df.orderBy("k", "u").collect()]
    for parts in (1, 5, 12):
        got = with_position(df.repartition(parts), ["k", "u"], num_partitions=parts)
        assert [r["u"] for r in got.orderBy("pos").collect()] == want
        assert sorted(r["pos"] for r in got.select("pos").collect()) == list(range(900))


def test_positions_write_nothing_and_survive_ties_and_empty_input(spark):
    df = spark.range(0, 3000, numPartitions=5).select("id", F.lit(1).alias("one"), F.col("id").cast("string").alias("payload"))
    plan = with_position(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Scan" not in plan and "staged" not in plan and "rangepartitioning" not in plan
    assert plan.count("Exchange") == 1
    assert sorted(r["pos"] for r in with_position(df, "one").collect()) == list(range(3000))
    assert with_position(df.limit(0), ["one", "id"]).count() == 0
    assert [r["pos"] for r in with_position(df.limit(1), "id").collect()] == [0]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_linear_scan_matches_loop(spark, parts):
    rng = np.random.default_rng(parts)
    n = 700
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n), "seq": rng.permutation(n), "x": rng.normal(size=n)})
    # one hot key with most rows
    pdf.loc[: n // 2, "k"] = 1
    df = spark.createDataFrame(pdf)
    for a, b in ((1.0, 1.0), (0.9, 0.1), (0.0, 1.0)):
        got = linear_scan(df, ["k"], ["seq"], "x", a, b, "s", num_partitions=parts).toPandas()
        got = got.sort_values(["k", "seq"])
        want = []
        for _, g in pdf.sort_values(["k", "seq"]).groupby("k", sort=True):
            s = None
            for v in g["x"]:
                s = v if s is None else a * s + b * v
                want.append(s)
        np.testing.assert_allclose(got["s"].to_numpy(), np.array(want), rtol=1e-9, atol=1e-12)


def test_metric_moments_finite_rule(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", 1e25), ("a", 3.0),
                                ("b", float("nan")), ("c", 2.0)], "name string, value double")
    got = {r["name"]: r for r in M.metric_summary(M.metric_moments(df)).collect()}
    assert got["a"]["num"] == 2 and got["a"]["sum"] == 4.0 and got["a"]["std"] == pytest.approx(1.0)
    assert got["b"]["num"] == 0 and np.isnan(got["b"]["mean"]) and np.isnan(got["b"]["std"])
    assert got["c"]["num"] == 1 and got["c"]["std"] == 0.0


def test_all_or_nothing_labels(spark):
    df = spark.createDataFrame([(0, 1), (1, None)], "idx int, label int")
    assert [r["label"] for r in L.all_or_nothing_labels(df).collect()] == [None, None]
    full = spark.createDataFrame([(0, 1), (1, 2)], "idx int, label int")
    assert sorted(r["label"] for r in L.all_or_nothing_labels(full).collect()) == [1, 2]
    empty = full.limit(0)
    assert L.all_or_nothing_labels(empty).count() == 0


def test_limit_samples_zero_and_none(spark):
    df = spark.range(5).withColumnRenamed("id", "idx")
    assert L.limit_samples(df, 0).count() == 0
    assert L.limit_samples(df, None).count() == 5


def test_manifest_later_duplicates_win(spark, tmp_path):
    p = tmp_path / "dataset.json"
    p.write_text(json.dumps({"labels": [["a.png", 1], ["b.png", 2], ["a.png", 7]]}))
    got = {r["name"]: r["label"] for r in L.read_label_manifest(spark, str(p)).collect()}
    assert got == {"a.png": 7, "b.png": 2}
    q = tmp_path / "null.json"
    q.write_text(json.dumps({"labels": None}))
    assert L.read_label_manifest(spark, str(q)).count() == 0


def test_uniform_square_offenders(spark):
    ok = spark.createDataFrame([(0, 64, 64), (1, 64, 64)], "idx int, w int, h int")
    assert L.uniform_square_offenders(ok).count() == 0
    bad = spark.createDataFrame([(0, 48, 48), (1, 64, 64)], "idx int, w int, h int")
    reasons = sorted(r["reason"] for r in L.uniform_square_offenders(bad).collect())
    assert reasons == ["not power of two", "size differs from first image"]
    with pytest.raises(ValueError):
        L.assert_uniform_square(bad)


def _dhariwal_loop(w, h, S_):
    while min(w, h) >= 2 * S_:
        w, h = w // 2, h // 2
    sc = S_ / min(w, h)
    return w, h, round(w * sc), round(h * sc)


def test_dhariwal_plan_equals_loop(spark):
    sizes = [(w, h) for w in (1, 63, 64, 65, 127, 128, 129, 257, 1000, 4099) for h in (64, 100, 513, 2048)]
    df = spark.createDataFrame(sizes, "w int, h int")
    got = df.select("w", "h", G.plan_dhariwal("w", "h", 64).alias("p")).collect()
    for r in got:
        hw, hh, nw, nh = _dhariwal_loop(r["w"], r["h"], 64)
        assert (r["p"]["half_w"], r["p"]["half_h"], r["p"]["resize_w"], r["p"]["resize_h"]) == (hw, hh, nw, nh)


def test_resample_constant_and_box():
    img = np.full((8, 6, 3), 77, dtype=np.uint8)
    for kind in ("lanczos", "bicubic", "box"):
        out = IM.to_uint8(IM.resize(img, 3, 5, kind))
        assert (out == 77).all()
    ramp = np.arange(16, dtype=np.uint8).reshape(4, 4, 1) * 10
    half = IM.resize(ramp, 2, 2, "box")[:, :, 0]
    want = ramp[:, :, 0].reshape(2, 2, 2, 2).mean(axis=(1, 3))
    np.testing.assert_allclose(half, want)


def test_transform_arguments():
    with pytest.raises(ValueError):
        IM.validate_transform_args("center-crop", None, None)
    with pytest.raises(ValueError):
        IM.validate_transform_args("center-crop-dhariwal", 64, 32)
    IM.validate_transform_args(None, None, None)


def test_parse_size_and_paths(spark):
    df = spark.createDataFrame([("4x2",), ("4,2",), ("4x2px",), ("x",)], "s string")
    got = [r["p"] for r in df.select(P.parse_size("s").alias("p")).collect()]
    assert [None if g is None else (g["w"], g["h"]) for g in got] == [(4, 2), (4, 2), None, None]
    names = spark.createDataFrame([("a/b.PNG",), ("png",), ("noext",), ("x.tar.gz",)], "p string")
    assert [r[0] for r in names.select(P.is_image_path("p")).collect()] == [True, True, False, False]


def test_epoch_batches_visit_each_row_once(spark):
    df = spark.range(103).withColumnRenamed("id", "i")
    b = S.epoch_batches(df, "i", 10, 3, 1).toPandas()
    assert len(b) == 100 and b["i"].is_unique
    assert b.groupby("batch_id").size().eq(10).all()
    b2 = S.epoch_batches(df.repartition(5), "i", 10, 3, 1).toPandas()
    assert b.sort_values("i")["batch_id"].tolist() == b2.sort_values("i")["batch_id"].tolist()


def test_infinite_sampler_covers_epochs(spark):
    df = spark.range(20).withColumnRenamed("id", "i")
    s = S.infinite_sampler(df, "i", 0, 1, 5, 0, 40).toPandas().sort_values("j")
    assert sorted(s[s["epoch"] == 0]["i"]) == list(range(20))
    assert sorted(s[s["epoch"] == 1]["i"]) == list(range(20))
    assert s[s["epoch"] == 0]["i"].tolist() != s[s["epoch"] == 1]["i"].tolist()


def test_archive_reader(spark, tmp_path):
    from featurelab.sinks.writers import png_bytes
    from featurelab.sources.files import scan_image_archives
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        for n in ("b/2.png", "a/1.png", "notes.txt"):
            f.writestr(n, png_bytes(bytes(12), 2, 2, 3))
    got = scan_image_archives(spark, str(z)).orderBy("idx").collect()
    assert [r["member"] for r in got] == ["a/1.png", "b/2.png"]
    assert all(r["label"] is None for r in got)


def test_with_position_dense_after_python_stage(spark):
    """Positions stay dense and unique when the input is itself a computed stage."""
    df = spark.range(0, 5000, numPartitions=7).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(5000)))
    df = df.mapInPandas(lambda it: (p for p in it), "id long, k long")
    got = with_position(df, ["k"], "pos").toPandas()
    assert sorted(got["pos"]) == list(range(5000))
    assert (got.sort_values("k")["pos"].to_numpy() == np.arange(5000)).all()


def test_carry_forward_and_variable_scan(spark):
    from featurelab.operators.scan import carry_forward
    pdf = pd.DataFrame({"k": [1] * 6 + [2] * 3, "t": list(range(6)) + list(range(3)),
                        "v": [5.0, 0.0, 0.0, 7.0, 0.0, 1.0, 0.0, 3.0, 0.0],
                        "live": [True, False, False, True, False, True, False, True, False]})
    got = carry_forward(spark.createDataFrame(pdf), ["k"], ["t"], "v", "live", "c").toPandas()
    got = got.sort_values(["k", "t"])["c"].tolist()
    assert got == [5.0, 5.0, 5.0, 7.0, 7.0, 1.0, 0.0, 3.0, 3.0]


def test_encoder_inputs_families(spark):
    from featurelab.functions.images import CLIP_MEAN, CLIP_STD, IMAGENET_MEAN, IMAGENET_STD
    img = np.full((256, 256, 3), 128, dtype=np.uint8)
    df = spark.createDataFrame([(0, {"height": 256, "width": 256, "nChannels": 3, "data": img.tobytes()})],
                               f"idx long, image {IM.IMAGE_STRUCT}")
    clip = IM.encoder_inputs(df, "clip").first()
    assert clip["shape"] == [3, 224, 224]
    v = np.asarray(clip["values"]).reshape(3, 224, 224)
    np.testing.assert_allclose(v[:, 0, 0], (128 / 255 - np.array(CLIP_MEAN)) / np.array(CLIP_STD), atol=1e-9)
    mae = IM.encoder_inputs(df, "mae").first()
    assert mae["shape"] == [3, 256, 256]
    v = np.asarray(mae["values"]).reshape(3, 256, 256)
    np.testing.assert_allclose(v[:, 5, 7], (128 / 255 - np.array(IMAGENET_MEAN)) / np.array(IMAGENET_STD), atol=1e-12)
    dino = IM.encoder_inputs(df, "dinov2").first()
    assert dino["shape"] == [3, 224, 224]


def test_encoder_inputs_interpolate_with_four_taps(spark):
    def weight(x):
        x, a = abs(x), -0.75
        return (a + 2) * x ** 3 - (a + 3) * x ** 2 + 1 if x <= 1 else a * x ** 3 - 5 * a * x ** 2 + 8 * a * x - 4 * a if x < 2 else 0.0

    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (7, 9, 3)).astype(np.uint8)
    want = np.zeros((5, 5, 3))
    for y in range(5):
        for x in range(5):
            sy, sx = (y + 0.5) * 7 / 5 - 0.5, (x + 0.5) * 9 / 5 - 0.5
            for j in range(int(np.floor(sy)) - 1, int(np.floor(sy)) + 3):
                for i in range(int(np.floor(sx)) - 1, int(np.floor(sx)) + 3):
                    want[y, x] += weight(j - sy) * weight(i - sx) * img[min(max(j, 0), 6), min(max(i, 0), 8)] / 255.0
    rows = [(0, {"height": 7, "width": 9, "nChannels": 3, "data": img.tobytes()}), (1, None)]
    df = spark.createDataFrame(rows, f"idx long, image {IM.IMAGE_STRUCT}").coalesce(1)
    got = {r["idx"]: r for r in IM.encoder_inputs(df, "clip-vit", side=5).collect()}
    norm = (want - np.array(G.CLIP_MEAN)) / np.array(G.CLIP_STD)
    np.testing.assert_allclose(np.reshape(got[0]["values"], (3, 5, 5)), norm.transpose(2, 0, 1), atol=1e-9)
    assert got[1]["values"] is None and got[1]["shape"] is None
    raw = IM.encoder_inputs(df, "vae").where("idx = 0").first()
    assert raw["shape"] == [3, 7, 9] and raw["values"] == img.transpose(2, 0, 1).ravel().astype(float).tolist()
    assert IM.encoder_inputs(df, "jepa").where("idx = 0").first()["shape"] == [3, 7, 9]  # no target below a width of 256


def test_empty_metric_inputs(spark):
    empty = spark.createDataFrame([], "name string, value double")
    assert M.metric_moments(empty).count() == 0
    assert M.cross_rank_mean(spark.createDataFrame([], "step long, name string, value double")).count() == 0


def test_grid_position_features_extra_tokens(spark):
    from featurelab.functions import vectors as V
    df = spark.range(0, 6).select(F.col("id").cast("int").alias("p"))
    rows = df.select("p", V.grid_position_features("p", 8, 2, extra=2).alias("f")).orderBy("p").collect()
    assert rows[0]["f"] == [0.0] * 8 and rows[1]["f"] == [0.0] * 8
    # token 2 is cell 0 (row 0, col 0): sin(0) = 0, cos(0) = 1 in both halves
    assert rows[2]["f"] == [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    # token 3 is cell 1 (row 0, col 1): the first half encodes the column
    w = [1.0, 1.0 / 100.0]
    np.testing.assert_allclose(rows[3]["f"][:4], [np.sin(w[0]), np.sin(w[1]), np.cos(w[0]), np.cos(w[1])])
    np.testing.assert_allclose(rows[3]["f"][4:], [0.0, 0.0, 1.0, 1.0])


@pytest.mark.parametrize("parts", [1, 5, 11])
def test_linear_scan_variable_coefficients_match_loop(spark, parts):
    rng = np.random.default_rng(100 + parts)
    n = 900
    pdf = pd.DataFrame({"k": rng.integers(0, 4, n), "seq": rng.permutation(n), "x": rng.normal(size=n),
                        "a": np.where(rng.random(n) < 0.15, 0.0, rng.uniform(0.2, 1.1, n)),
                        "b": rng.uniform(0.0, 1.0, n)})
    pdf.loc[: n // 2, "k"] = 2  # hot key spanning partitions
    got = linear_scan(spark.createDataFrame(pdf), ["k"], ["seq"], "x", "a", "b", "s",
                      num_partitions=parts).toPandas().sort_values(["k", "seq"])
    want = []
    for _, g in pdf.sort_values(["k", "seq"]).groupby("k", sort=True):
        s = None
        for x, a, b in zip(g["x"], g["a"], g["b"]):
            s = x if s is None else a * s + b * x
            want.append(s)
    np.testing.assert_allclose(got["s"].to_numpy(), np.array(want), rtol=1e-9, atol=1e-12)


def test_unpatchify_multichannel_and_non_square(spark):
    from featurelab.functions import vectors as V
    p, c, h = 2, 3, 2
    tokens = np.arange(h * h * p * p * c, dtype=float).reshape(h * h, p * p * c)
    want = np.einsum("hwpqc->chpwq", tokens.reshape(h, h, p, p, c)).reshape(c, h * p, h * p).ravel()
    df = spark.createDataFrame([(0, tokens.tolist())], "id long, tokens array<array<double>>")
    got = df.select(V.unpatchify("tokens", p, c).alias("img")).first()["img"]
    np.testing.assert_array_equal(np.array(got), want)
    bad = spark.createDataFrame([(0, tokens[:3].tolist())], "id long, tokens array<array<double>>")
    with pytest.raises(Exception, match="not a square"):
        bad.select(V.unpatchify("tokens", p, c)).collect()


def test_strict_modes_raise(spark):
    from featurelab.operators import align as A
    from featurelab.sources import files as SRC
    samples = spark.createDataFrame([("a.png",), ("b.png",)], "name string")
    manifest = spark.createDataFrame([("a.png", 1)], "name string, label int")
    assert L.attach_labels(samples, manifest).count() == 2
    with pytest.raises(KeyError):
        L.attach_labels(samples, manifest, strict=True)
    dst = spark.createDataFrame([("w", 1.0), ("v", 2.0)], "name string, value double")
    src = spark.createDataFrame([("w", 5.0)], "name string, value double")
    assert sorted(r["value"] for r in A.merge_by_name(dst, src).collect()) == [2.0, 5.0]
    with pytest.raises(KeyError):
        A.merge_by_name(dst, src, require_all=True)
    man = spark.range(0, 5).withColumnRenamed("id", "index")
    imgs = spark.range(0, 3).withColumnRenamed("id", "index")
    assert A.collect_samples(man, imgs, 3).count() == 3
    with pytest.raises(ValueError):
        A.collect_samples(man, imgs, 5)
    a = spark.createDataFrame([("x",), ("y",)], "path string")
    b = spark.createDataFrame([("z",)], "path string")
    with pytest.raises(ValueError):
        A.align_modalities({"a": a, "b": b})
    with pytest.raises(ValueError):
        SRC.open_dataset(spark, "/root/testdata/sf0.001/region.parquet")


def test_consistency_assertions(spark):
    from featurelab.operators import align as A
    same = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "b", 1)],
                                 "event_id long, name string, rank int")
    M.assert_same_names(same)
    differ = spark.createDataFrame([(0, "a", 0), (1, "b", 1), (2, "b", 0), (3, "a", 1)],
                                   "event_id long, name string, rank int")
    with pytest.raises(ValueError):
        M.assert_same_names(differ)
    rep = spark.createDataFrame([(0, "w", [1.0, float("nan")]), (1, "w", [1.0, 0.0]), (1, "u", [2.0]),
                                 (0, "u", [2.0])], "rank int, name string, values array<double>")
    A.assert_replicas_consistent(rep)  # NaN on one replica equals 0 on another after cleaning
    rep2 = rep.union(spark.createDataFrame([(2, "u", [3.0])], "rank int, name string, values array<double>"))
    with pytest.raises(AssertionError):
        A.assert_replicas_consistent(rep2)
    A.assert_replicas_consistent(rep2, ignore_regex="u")


def test_microstep_rollup_matches_loop(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"seq": np.arange(n), "is_sync": rng.random(n) < 0.3,
                        "fwd": rng.random(n), "ema": rng.random(n)})
    pdf.loc[n - 1, "is_sync"] = False  # trailing micro-steps never close a step
    want, acc_f, acc_e, k = [], 0.0, 0.0, 0
    for f_, e_, s_ in zip(pdf["fwd"], pdf["ema"], pdf["is_sync"]):
        acc_f += f_
        k += 1
        if s_:
            acc_e += e_
            want.append((k, acc_f, acc_e))
            acc_f, acc_e, k = 0.0, 0.0, 0
    got = M.microstep_rollup(spark.createDataFrame(pdf), ["seq"], "is_sync", ["fwd"], ["ema"]).toPandas()
    got = got.sort_values("step")
    assert got["step"].tolist() == list(range(1, len(want) + 1))
    np.testing.assert_allclose(got[["n_micro", "fwd", "ema"]].to_numpy(), np.array(want), rtol=1e-12)


@pytest.mark.parametrize("keep", [False, True])
def test_moments_delta_matches_collector(spark, keep):
    # cumulative snapshots of two names; "b" gets no reports at update 2
    per = {("a", 0): (2, 3.0, 5.0), ("b", 0): (1, 2.0, 4.0), ("a", 1): (1, 1.0, 1.0), ("b", 1): (2, 6.0, 20.0),
           ("a", 2): (3, 6.0, 14.0), ("b", 2): (0, 0.0, 0.0)}
    rows, cum = [], {}
    for u in range(3):
        for nm in ("a", "b"):
            c = cum.get(nm, (0, 0.0, 0.0))
            d = per[(nm, u)]
            cum[nm] = (c[0] + d[0], c[1] + d[1], c[2] + d[2])
            rows.append((u, nm) + cum[nm])
    snaps = spark.createDataFrame(rows, "update long, name string, num long, sum double, sumsq double")
    got = {(r["update"], r["name"]): (r["num"], r["sum"]) for r in M.moments_delta(snaps, keep).collect()}
    last = {}
    for u in range(3):
        for nm in ("a", "b"):
            d = per[(nm, u)]
            if d[0] != 0:
                last[nm] = d
            want = (d[0], d[1]) if d[0] != 0 else ((last[nm][0], last[nm][1]) if keep else (0, 0.0))
            assert got[(u, nm)] == want


def test_wide_crop_canvas(spark):
    img = np.full((8, 16, 3), 200, dtype=np.uint8)  # h=8, w=16
    df = spark.createDataFrame([(0, {"height": 8, "width": 16, "nChannels": 3, "data": img.tobytes()})],
                               f"idx long, image {IM.IMAGE_STRUCT}")
    r = IM.transform_images(df, "center-crop-wide", 8, 4).first()
    assert r["error"] is None and (r["image"]["height"], r["image"]["width"]) == (8, 8)
    out = np.frombuffer(r["image"]["data"], dtype=np.uint8).reshape(8, 8, 3)
    assert (out[:2] == 0).all() and (out[6:] == 0).all() and (out[2:6] == 200).all()


def test_distance_tiles_stay_under_their_bound():
    from featurelab.operators import distance as D
    for rows, dim in ((10_000_000, 64), (10_000_000, 2048), (500, 64)):
        block = -(-rows // D.auto_blocks(rows, dim, 64))
        assert block * dim * 8 <= D.BLOCK_BYTES + 8 * dim
        assert D.tile_rows(block) * block * 8 <= max(D.TILE_BYTES, 8 * block)


def test_rows_without_features_take_no_part(spark):
    from featurelab.operators import distance as D
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(19)]
    df = spark.createDataFrame(rows + [(99, None)], "id long, features array<double>")
    got = {r["id"]: round(r["radius"], 9) for r in D.knn_radii(df, ks=(3,)).collect()}
    x = np.array([v for _, v in rows])
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 3]
    assert got == {i: round(float(d[i]), 9) for i in range(19)}


def test_recurrence_resets_and_small_coefficients():
    from featurelab.operators.scan import _recur_var
    x, one = np.arange(1.0, 5.0), np.ones(4)
    assert _recur_var(x, np.array([0.0, 1, 1, 1]), one, float("nan")).tolist() == [1, 3, 6, 10]
    a = np.full(200, 1e-6)
    got, want, s = _recur_var(np.ones(200), a, np.ones(200), 1.0), [], 1.0
    for _ in range(200):
        s = 1e-6 * s + 1
        want.append(s)
    assert np.allclose(got, want)


def test_one_large_manifest_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "DOCUMENT_BYTES", 1000)
    rows = [[f"{i % 900:05d}/img \"{i % 900}\" [é].png", i] for i in range(4000)] + [["last.png", None]]
    vectors = [[n, None if v is None else [v, 0.5]] for n, v in rows]
    for kind, data in (("scalars", rows), ("vectors", vectors)):
        for style, text in (("plain", json.dumps({"labels": data})), ("indented", json.dumps({"labels": data}, indent=2)),
                            ("odd", json.dumps({"labels": [*data, ["a],b.png", data[0][1]]]}))):
            f = tmp_path / f"{kind}-{style}.json"
            f.write_text(text)
            pieces = L.split_manifest(spark, str(f))
            assert (pieces is None) == (style == "odd")
            want = {n: v for n, v in json.loads(text)["labels"]}
            spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
            try:
                got = L.read_label_manifest(spark, str(f), vectors=kind == "vectors")
                assert {r["name"]: r["label"] for r in got.collect()} == want
                assert style == "odd" or L.split_manifest(spark, str(f)).rdd.getNumPartitions() > 3
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for text in ('{"labels": null}' + " " * 2000, '{"labels": []}' + " " * 2000):
        (tmp_path / "none.json").write_text(text)
        assert L.read_label_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "d0.json").write_text(json.dumps({"labels": [["x.png", 1], ["y.png", 2]] + rows[:50]}))
    (tmp_path / "d1.json").write_text(json.dumps({"labels": [["x.png", 3]]}))
    got = {r["name"]: r["label"] for r in L.read_label_manifest(spark, str(tmp_path / "d*.json")).collect()}
    assert (got["x.png"], got["y.png"]) == (3, 2)
