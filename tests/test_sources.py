"""File sources and sinks on small generated files."""
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators.images import read_images
from featurelab.sinks import writers as W
from featurelab.sources import files as S


def _png(path, value, w=2, h=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(W.png_bytes(bytes([value]) * (w * h * 3), w, h, 3))


def test_list_files_ignores_prune_dirs_and_files(spark, tmp_path):
    for rel in ("a/x.png", "a/skip/y.png", "b/z.tmp", "b/w.png", "top.png"):
        _png(tmp_path / rel, 1)
    got = sorted(r["rel_path"] for r in S.list_files(spark, str(tmp_path), ignores=["skip", "*.tmp"]).collect())
    assert got == ["a/x.png", "b/w.png", "top.png"]
    base = S.list_files(spark, str(tmp_path), add_base_to_relative=True).select("rel_path").first()[0]
    assert base.startswith(tmp_path.name + "/")


def test_scan_images_folder_labels_and_root_files(spark, tmp_path):
    for rel in ("cat/1.png", "dog/2.png", "3.png", "notes.txt"):
        _png(tmp_path / rel, 5)
    got = {r["rel_path"]: (r["idx"], r["label"]) for r in S.scan_images(spark, str(tmp_path)).collect()}
    # sorted: 3.png (''), cat/1.png, dog/2.png ; classes sorted: '', cat, dog
    assert got == {"3.png": (0, 0), "cat/1.png": (1, 1), "dog/2.png": (2, 2)}
    assert S.scan_images(spark, str(tmp_path), max_images=0).count() == 0


def test_scan_images_single_folder_has_no_labels(spark, tmp_path):
    for rel in ("only/1.png", "only/2.png"):
        _png(tmp_path / rel, 5)
    assert all(r["label"] is None for r in S.scan_images(spark, str(tmp_path)).collect())


def test_scan_images_manifest_wins_and_null_manifest_falls_back(spark, tmp_path):
    for rel in ("a/1.png", "b/2.png"):
        _png(tmp_path / rel, 5)
    (tmp_path / "dataset.json").write_text(json.dumps({"labels": [["a/1.png", 7], ["b/2.png", 9]]}))
    got = {r["rel_path"]: r["label"] for r in S.scan_images(spark, str(tmp_path)).collect()}
    assert got == {"a/1.png": 7, "b/2.png": 9}
    (tmp_path / "dataset.json").write_text(json.dumps({"labels": None}))
    got = {r["rel_path"]: r["label"] for r in S.scan_images(spark, str(tmp_path)).collect()}
    assert got == {"a/1.png": 0, "b/2.png": 1}


def test_ingest_arrays_and_batches(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(tmp_path / "one.npy", a)
    r = S.ingest_arrays(spark, str(tmp_path / "*.npy")).first()
    assert r["shape"] == [3, 4] and r["dtype"] == "float32" and r["values"] == list(map(float, a.ravel()))
    stack = np.random.default_rng(0).random((10, 2, 3))
    buf = io.BytesIO()
    np.savez(buf, arr_0=stack, other=np.zeros(1))
    (tmp_path / "b.npz").write_bytes(buf.getvalue())
    rows = sorted(S.ingest_array_batches(spark, str(tmp_path), "arr_0", batch_size=3).collect(), key=lambda x: x["row"])
    assert [x["row"] for x in rows] == list(range(10))
    np.testing.assert_allclose(np.array([x["values"] for x in rows]), stack.reshape(10, -1))
    with pytest.raises(Exception):
        S.ingest_array_batches(spark, str(tmp_path), "missing").collect()


def test_feature_set_siblings(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"t{i}_cls.npy", np.zeros(2))
    np.save(tmp_path / "t0_patches.npy", np.zeros((2, 2)))
    f = S.scan_feature_set(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["rel_path"] for r in f] == ["t0_cls.npy", "t1_cls.npy", "t2_cls.npy"]
    assert f[0]["sibling"].endswith("t0_patches.npy")


def test_png_roundtrip_through_spark_image_source(spark, tmp_path):
    px = np.arange(4 * 3 * 3, dtype=np.uint8).reshape(4, 3, 3)  # h=4, w=3, RGB
    (tmp_path / "i.png").write_bytes(W.png_bytes(px.tobytes(), 3, 4, 3))
    img = read_images(spark, str(tmp_path / "i.png")).first()["image"]
    got = np.frombuffer(img["data"], dtype=np.uint8).reshape(img["height"], img["width"], img["nChannels"])
    np.testing.assert_array_equal(got, px)


def test_manifest_documents_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(0, "a.png", 1), (1, "b.png", None)], "idx int, archive_path string, label int")
    W.write_manifest(df, str(tmp_path / "m"), documents=True)
    assert json.loads((tmp_path / "m" / "dataset-00000.json").read_text()) == {"labels": None}
    ok = spark.createDataFrame([(3, "d.png", 0), (1, "b.png", 2), (0, "a.png", 1), (2, "c.png", 5)], "idx int, archive_path string, label int")
    W.write_manifest(ok, str(tmp_path / "m2"), documents=True, rows=3)
    first, second = (json.loads((tmp_path / "m2" / f"dataset-0000{i}.json").read_text()) for i in (0, 1))
    assert first == {"labels": [["a.png", 1], ["b.png", 2], ["c.png", 5]]} and second == {"labels": [["d.png", 0]]}
    assert sorted(p.name for p in (tmp_path / "m2").iterdir() if not p.name.startswith(".")) == ["dataset-00000.json", "dataset-00001.json"]


def test_flows_transform_and_encode_once(spark, tmp_path):
    """Every call of the encoder leaves a mark per image; actions on the results write nothing again."""
    from featurelab.plans.prepare import convert_dataset, encode_dataset
    for i in range(6):
        p = tmp_path / "src" / "ab"[i % 2] / f"{i}.png"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(W.png_bytes(bytes([40 * i]) * (8 * 8 * 3), 8, 8, 3))
    (tmp_path / "src" / "a" / "x.png").write_bytes(b"broken")
    (tmp_path / "src" / "b" / "y.webp").write_bytes(b"unknown")
    marks = tmp_path / "marks"
    marks.mkdir()
    conv = str(tmp_path / "conv")
    out = convert_dataset(spark, str(tmp_path / "src"), conv, "center-crop-dhariwal", 4, 4)
    assert sorted((r["idx"], r["label"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 0), (4, 1), (5, 1), (6, 1)]
    when = {p: p.stat().st_mtime_ns for p in (tmp_path / "conv").rglob("*.png")}
    out.count()
    assert len(when) == 6 and when == {p: p.stat().st_mtime_ns for p in (tmp_path / "conv").rglob("*.png")}
    bad = spark.read.parquet(conv + "/_rejected").collect()
    assert sorted((r["idx"], r["source"].rsplit("/", 1)[1]) for r in bad) == [(3, "x.png"), (7, "y.webp")]
    assert {r["rel_path"]: r["label"] for r in S.scan_images(spark, conv).collect()} == {r["archive_path"]: r["label"] for r in out.collect()}
    with pytest.raises(ValueError, match="not empty"):
        convert_dataset(spark, str(tmp_path / "src"), conv, "center-crop-dhariwal", 4, 4)

    folder = str(marks)

    def make():
        def encode(x):
            import os
            import uuid
            for _ in range(len(x)):
                open(os.path.join(folder, f"e-{uuid.uuid4().hex}"), "w").close()
            return x.reshape(len(x), -1)[:, :2]
        return encode
    enc = encode_dataset(spark, conv, str(tmp_path / "enc"), make, 2)
    assert enc.count() == 6 and enc.where("label is null").count() == 0
    assert len([p for p in marks.iterdir() if p.name.startswith("e-")]) == 6


def test_report_text_order():
    t = W.report_text({"Inception Score": 1.5, "FID": 2.0, "sFID": 3.0, "Precision": 0.5, "Recall": 0.25})
    assert t.splitlines() == ["Inception Score: 1.5", "FID: 2.0", "sFID: 3.0", "Precision: 0.5", "Recall: 0.25"]


def test_write_dataset_refuses_existing(spark, tmp_path):
    df = spark.createDataFrame([(0, "x"), (1, "y")], "idx long, v string")
    W.write_dataset(df, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d")).orderBy("idx").collect()
    assert [r["archive_path"] for r in back] == ["00000/img00000000.png", "00000/img00000001.png"]
    with pytest.raises(Exception):
        W.write_dataset(df, str(tmp_path / "d"))


def test_load_npz_stats_and_fallback(spark, tmp_path):
    from featurelab.operators.stats import fit_statistics
    from featurelab.plans import fixtures as fx
    f = fx.features(spark, "/root/testdata/sf0.001")
    st = fit_statistics(f)
    np.savez(tmp_path / "ref.npz", mu=st.mu, sigma=st.sigma, mu_s=st.mu[:4], sigma_s=st.sigma[:4, :4])
    got = S.load_or_compute_stats(f, str(tmp_path / "ref.npz"))
    np.testing.assert_allclose(got.sigma, st.sigma)
    sp = S.load_or_compute_stats(f, str(tmp_path / "ref.npz"), spatial=True)
    assert sp.mu.shape == (4,)
    missing = S.load_or_compute_stats(f, str(tmp_path / "none.npz"))  # absent: computed
    np.testing.assert_allclose(missing.mu, st.mu, atol=1e-12)


def test_encode_tokens_flow(spark, tmp_path):
    from featurelab.operators.align import missing_siblings
    from featurelab.plans.prepare import convert_dataset, encode_tokens_dataset
    for i, rel in enumerate(("a/1.png", "a/2.png", "b/3.png")):
        p = tmp_path / "src" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(W.png_bytes(bytes([10 * (i + 1)]) * (8 * 8 * 3), 8, 8, 3))
    conv = tmp_path / "conv"
    convert_dataset(spark, str(tmp_path / "src"), str(conv), "center-crop-dhariwal", 4, 4)
    T, D_ = 1 + 4 + 3, 2  # class + 4 registers + 3 patches, width 2

    def make():
        return lambda x: np.repeat(x.reshape(x.shape[0], -1).mean(axis=1)[:, None], T * D_, axis=1) \
            + np.arange(T * D_)[None, :]
    out = encode_tokens_dataset(spark, str(conv), str(tmp_path / "tok"), make, T, D_).orderBy("idx").collect()
    assert [r["cls_path"] for r in out] == [f"00000/img-dinov3-0000000{i}_cls.npy" for i in range(3)]
    cls0 = np.load(tmp_path / "tok" / out[0]["cls_path"])
    patches0 = np.load(tmp_path / "tok" / out[0]["patches_path"])
    assert cls0.tolist() == [10.0, 11.0] and patches0.shape == (3, 2)
    assert patches0[0].tolist() == [10.0 + 10, 10.0 + 11]  # first patch token follows the 4 registers
    listing = S.list_files(spark, str(tmp_path / "tok"))
    assert missing_siblings(listing.select(F.col("rel_path").alias("path")),
                            listing.select(F.col("rel_path").alias("path"))).count() == 0


def test_training_set_checks(spark, tmp_path):
    from featurelab.operators.scoring import channel_moments_encoder, quadrant_token_encoder
    from featurelab.plans.prepare import convert_dataset, encode_dataset, encode_tokens_dataset, load_training_set
    for rel in ("a/1.png", "a/2.png", "b/3.png"):
        p = tmp_path / "src" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(W.png_bytes(bytes([int(rel[2]) * 20]) * (8 * 8 * 3), 8, 8, 3))
    conv, enc, tok = (str(tmp_path / x) for x in ("conv", "enc", "tok"))
    convert_dataset(spark, str(tmp_path / "src"), conv, "center-crop-dhariwal", 4, 4)
    encode_dataset(spark, conv, enc, channel_moments_encoder(), 6)
    encode_tokens_dataset(spark, conv, tok, quadrant_token_encoder(), 9, 2, dtype="float16")
    rows = load_training_set(spark, conv, enc, tok).orderBy("idx").collect()
    assert [(r["image"], r["label"], r["latents"][0], r["cls"][0], r["patch_shape"]) for r in rows] == [
        (f"00000/img0000000{i}.png", label, v, v, [4, 2]) for i, label, v in ((0, 0, 20.0), (1, 0, 40.0), (2, 1, 60.0))]
    # vector labels
    manifest = tmp_path / "enc" / "dataset-00000.json"
    pairs = json.loads(manifest.read_text())["labels"]
    manifest.write_text(json.dumps({"labels": [[n, [0.1, float(v)]] for n, v in pairs]}))
    assert [r["label"] for r in load_training_set(spark, conv, enc, vector_labels=True).orderBy("idx").collect()] == [[0.1, 0.0], [0.1, 0.0], [0.1, 1.0]]
    with pytest.raises(Exception, match="whole numbers"):
        load_training_set(spark, conv, enc).collect()
    manifest.write_text(json.dumps({"labels": pairs[:2]}))
    with pytest.raises(KeyError):
        load_training_set(spark, conv, enc)
    next((tmp_path / "tok").rglob("*0_patches.npy")).rename(tmp_path / "gone.npy")
    with pytest.raises(FileNotFoundError, match="without patches"):
        load_training_set(spark, conv, enc, tok)
    next((tmp_path / "enc").rglob("*.npy")).rename(tmp_path / "gone2.npy")
    with pytest.raises(ValueError, match="different numbers"):
        load_training_set(spark, conv, enc)


def test_conversion_from_zip(spark, tmp_path):
    import zipfile

    from featurelab.plans.prepare import convert_dataset
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"s{k}.zip", "w") as z:
            for i in range(3):
                z.writestr(f"m{i}.png", W.png_bytes(bytes([50 * k + 10 * i]) * (8 * 8 * 3), 8, 8, 3))
            z.writestr("dataset.json", json.dumps({"labels": [[f"m{i}.png", i + 10 * k] for i in range(3)]}))
    out = convert_dataset(spark, str(tmp_path / "s*.zip"), str(tmp_path / "conv"), "scale", 4, 4, max_images=5)
    assert sorted((r["idx"], r["label"]) for r in out.collect()) == [(0, 0), (1, 1), (2, 2), (3, 10), (4, 11)]


def test_metric_names_by_regex(spark):
    from featurelab.operators.metrics import select_metrics
    df = spark.createDataFrame([("loss",), ("loss_a",), ("time_x",), ("grad",)], "name string")
    assert sorted(r[0] for r in select_metrics(df, regex="loss|grad").collect()) == ["grad", "loss"]
    assert select_metrics(df, prefixes=()).count() == 0


def _counting(log):
    """An opener whose files leave the number of bytes read from them in a log file (local classes travel to the tasks)."""
    class Counted(io.FileIO):
        n = 0

        def read(self, size=-1):
            data = super().read(size)
            self.n += len(data)
            return data

        def readinto(self, b):
            k = super().readinto(b)
            self.n += k
            return k

        def close(self):
            if not self.closed:
                with open(log, "a") as f:
                    f.write(f"{self.n}\n")
            super().close()

    return lambda uri: Counted(uri.replace("file:", "", 1))


def _taken(log):
    n = sum(map(int, log.read_text().split())) if log.exists() else 0
    log.write_text("")
    return n


def test_archive_members_are_read_by_range(spark, tmp_path):
    big, rng = tmp_path / "a.zip", np.random.default_rng(3)
    data = {f"{i % 3}/{i:03}.png": rng.bytes(100_000) for i in range(40)}
    with zipfile.ZipFile(big, "w") as z:
        for i, (n, b) in enumerate(data.items()):
            z.writestr(n, b, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.writestr("dataset.json", json.dumps({"labels": [[n, i] for i, n in enumerate(data)] + [["0/000.png", 77]]}))
        z.writestr("folder/", b"")
    log = tmp_path / "log"
    opener = _counting(str(log))
    found = S.scan_image_archives(spark, str(big), opener=opener)
    rows = found.orderBy("idx").collect()
    assert [r["member"] for r in rows] == sorted(data) and rows[0]["label"] == 77
    # the directory and the manifest, in a few passes; no member
    assert _taken(log) < 300_000 < big.stat().st_size / 10
    one = S.read_archive_members(spark, found.where("idx = 7"), opener).collect()
    assert len(one) == 1 and one[0]["content"] == data[sorted(data)[7]]
    assert _taken(log) < 100_000 + 400_000
    every = {r["member"]: r["content"] for r in S.read_archive_members(spark, found, opener).collect()}
    assert every == data
    with zipfile.ZipFile(big) as z:
        offset = z.getinfo(sorted(data)[7]).header_offset
    with open(big, "r+b") as f:
        f.seek(offset + 200)
        f.write(b"\x00\x01\x02\x03")
    with pytest.raises(Exception, match="checksum|decompress"):
        S.read_archive_members(spark, found.where("idx = 7")).collect()


def test_a_store_that_only_spark_reads_ships_each_archive_once(spark, tmp_path, monkeypatch):
    for a in ("x", "y"):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            for i in range(5):
                z.writestr(f"{i}.png", f"{a}{i}".encode() * 50)
    monkeypatch.setattr(S, "reachable", lambda uri: False)
    found = S.scan_image_archives(spark, str(tmp_path / "*.zip"))
    rows = S.read_archive_members(spark, found)
    assert sorted((r["archive"][-5:], r["member"], bytes(r["content"])) for r in rows.collect()) == sorted(
        (f"{a}.zip", f"{i}.png", f"{a}{i}".encode() * 50) for a in "xy" for i in range(5))
    monkeypatch.setattr(S, "MAX_SHIPPED_BYTES", 10)
    with pytest.raises(ValueError, match="only Spark reads"):
        S.scan_image_archives(spark, str(tmp_path / "*.zip"))


def test_vector_labels_inside_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("0.png", "1.png", "2.png"):
            z.writestr(n, b"x")
        z.writestr("dataset.json", json.dumps({"labels": [["0.png", [1, 2.5]], ["1.png", 3]]}))
    found = S.scan_image_archives(spark, str(tmp_path / "a.zip"), vectors=True)
    assert [r["label"] for r in found.orderBy("idx").collect()] == [[1.0, 2.5], [3.0], None]
    assert [r["label"] for r in S.read_archive_members(spark, found).orderBy("idx").collect()] == [[1.0, 2.5], [3.0], None]
    with pytest.raises(Exception, match="whole numbers"):
        S.scan_image_archives(spark, str(tmp_path / "a.zip")).collect()


def test_stored_arrays_are_read_by_row_ranges(spark, tmp_path, monkeypatch):
    stack = np.random.default_rng(0).random((40, 30, 20))
    np.savez(tmp_path / "plain.npz", arr_0=stack, other=np.zeros(3))
    np.savez_compressed(tmp_path / "packed.npz", arr_0=stack.astype(np.float32))
    np.savez(tmp_path / "columns.npz", arr_0=np.asfortranarray(stack))
    np.savez(tmp_path / "none.npz", arr_0=np.zeros((0, 4)))
    np.savez(tmp_path / "flat.npz", arr_0=np.arange(5))
    monkeypatch.setattr(S, "RANGE_BYTES", 20_000)
    log = tmp_path / "log"
    rows = S.ingest_array_batches(spark, str(tmp_path / "plain.npz"), batch_size=3, opener=_counting(str(log))).collect()
    assert [x["row"] for x in sorted(rows, key=lambda x: x["row"])] == list(range(40)) and len(log.read_text().split()) > 10
    assert _taken(log) < 1.2 * stack.nbytes
    got = {}
    for r in S.ingest_array_batches(spark, str(tmp_path), batch_size=7).collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], {})[r["row"]] = (r["shape"], r["values"])
    for name in ("plain.npz", "packed.npz", "columns.npz"):
        assert sorted(got[name]) == list(range(40)) and got[name][3][0] == [30, 20]
        np.testing.assert_allclose([got[name][i][1] for i in range(40)], stack.reshape(40, -1), rtol=1e-6)
    assert [got["flat.npz"][i] for i in range(5)] == [([], [float(i)]) for i in range(5)] and "none.npz" not in got


def _folder(root, n, labelled=True):
    for i in range(n):
        p = root / ("ab"[i % 2] if labelled else "a") / f"{i}.png"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(W.png_bytes(bytes([10 * i]) * (8 * 8 * 3), 8, 8, 3))


def test_zip_destination_scans_back(spark, tmp_path):
    from featurelab.plans.prepare import convert_dataset
    _folder(tmp_path / "src", 9)
    (tmp_path / "src" / "a" / "x.png").write_bytes(b"broken")
    dest = str(tmp_path / "out" / "set.zip")
    (tmp_path / "out").mkdir()
    out = convert_dataset(spark, str(tmp_path / "src"), dest, "center-crop-dhariwal", 4, 4)
    want = {(r["archive_path"], r["label"]) for r in out.collect()}
    assert len(want) == 9
    found = S.scan_image_archives(spark, str(tmp_path / "out" / "set*.zip"))
    assert {(r["member"], r["label"]) for r in found.collect()} == want
    assert [r["member"] for r in found.orderBy("idx").collect()] == sorted(n for n, _ in want)
    assert not list((tmp_path / "out").glob("*.work"))
    bad = spark.read.parquet(str(tmp_path / "out" / "set_rejected")).collect()
    assert [r["source"].rsplit("/", 1)[1] for r in bad] == ["x.png"]
    with zipfile.ZipFile(sorted((tmp_path / "out").glob("set*.zip"))[0]) as z:
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert z.testzip() is None
    with pytest.raises(ValueError, match="exists"):
        convert_dataset(spark, str(tmp_path / "src"), dest, "center-crop-dhariwal", 4, 4)


def _images(spark, n, labels, error_at=None):
    px = bytes(range(48))
    rows = [(i, None if i == error_at else (4, 4, 3, px), "e" if i == error_at else None, labels(i)) for i in range(n)]
    return spark.createDataFrame(rows, "idx int, image struct<height:int,width:int,nChannels:int,data:binary>, error string, label int").repartition(3)


def test_archives_are_cut_by_rows_and_share_one_label_rule(spark, tmp_path):
    from featurelab.sinks.archives import write_image_archives
    full = write_image_archives(_images(spark, 10, lambda i: i, error_at=4), str(tmp_path / "f.zip"), rows_per_archive=2)
    assert sorted((r["idx"], r["archive_path"] is None) for r in full.collect()) == [(i, i == 4) for i in range(10)]
    names = sorted(p.name for p in tmp_path.glob("f*.zip"))
    assert names == [f"f-{i:05d}.zip" for i in range(len(names))] and len(names) >= 5
    assert {r["member"][-6:-4]: r["label"] for r in S.scan_image_archives(spark, str(tmp_path / "f-*.zip")).collect()} == {
        f"{i:02}": i for i in range(10) if i != 4}
    write_image_archives(_images(spark, 10, lambda i: None if i == 7 else i), str(tmp_path / "g.zip"), rows_per_archive=2)
    assert {r["label"] for r in S.scan_image_archives(spark, str(tmp_path / "g-*.zip")).collect()} == {None}
    write_image_archives(_images(spark, 1, lambda i: i).where("idx > 5"), str(tmp_path / "none.zip"))
    with zipfile.ZipFile(tmp_path / "none.zip") as z:
        assert json.loads(z.read("dataset.json")) == {"labels": []}


def test_a_failing_task_leaves_no_archive(spark, tmp_path):
    from featurelab.sinks.archives import write_image_archives
    bad = _images(spark, 10, lambda i: i).withColumn("image", F.when(F.col("idx") == 6, F.raise_error(F.lit("boom"))).otherwise(F.col("image")))
    with pytest.raises(Exception, match="boom"):
        write_image_archives(bad, str(tmp_path / "h.zip"), rows_per_archive=2)
    assert list(tmp_path.iterdir()) == []
    odd = _images(spark, 10, lambda i: i).withColumn("image", F.when(F.col("idx") == 6, F.col("image").withField("nChannels", F.lit(2)))
                                                     .otherwise(F.col("image")))
    with pytest.raises(Exception, match="KeyError"):  # in the writer
        write_image_archives(odd, str(tmp_path / "h.zip"), rows_per_archive=2)
    assert list(tmp_path.iterdir()) == []


def test_source_size_images_cross_no_exchange(spark, tmp_path, monkeypatch):
    from featurelab.plans import prepare
    _folder(tmp_path / "src", 4)
    seen = {}
    real = prepare.write_image_files
    monkeypatch.setattr(prepare, "write_image_files", lambda df, dest: seen.setdefault("plan", df._jdf.queryExecution().sparkPlan().toString()) and real(df, dest))
    prepare.convert_dataset(spark, str(tmp_path / "src"), str(tmp_path / "out"), "center-crop-dhariwal", 4, 4, max_images=3)
    lines = seen["plan"].splitlines()
    scan = next(i for i, x in enumerate(lines) if "image" in x and "Scan" in x and "origin" in x or "FileScan image" in x)
    above = [x for x in lines[:scan] if "MapInPandas" in x]
    assert len(above) == 2  # decode, transform: on top of the scan, before any join
    last = max(i for i, x in enumerate(lines) if "Join" in x and "SemiJoin" not in x and "LeftSemi" not in x)
    assert last < lines.index(above[0])


def test_manifest_of_an_empty_dataset(spark, tmp_path):
    df = spark.createDataFrame([], "idx int, archive_path string, label int")
    W.write_manifest(df, str(tmp_path / "m"), documents=True)
    assert json.loads((tmp_path / "m" / "dataset-00000.json").read_text()) == {"labels": []}


def test_training_arrays_cross_no_exchange(spark, tmp_path):
    from featurelab.operators import scoring as SC
    from featurelab.plans.prepare import convert_dataset, encode_dataset, encode_tokens_dataset, load_training_set
    _folder(tmp_path / "src", 6)
    conv, enc, tok = (str(tmp_path / x) for x in ("conv", "enc", "tok"))
    convert_dataset(spark, str(tmp_path / "src"), conv, "center-crop-dhariwal", 4, 4)
    encode_dataset(spark, conv, enc, SC.channel_moments_encoder(), 6)
    encode_tokens_dataset(spark, conv, tok, SC.quadrant_token_encoder(), 9, 2)
    out = load_training_set(spark, conv, enc, tok)
    assert out.columns == ["idx", "image", "label", "latents", "latent_shape", "cls", "patches", "patch_shape"]
    rows = out.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(6)) and {r["label"] for r in rows} == {0, 1}
    for r in rows:
        s = f"{r['idx']:08d}"
        np.testing.assert_allclose(r["latents"], np.load(f"{enc}/{s[:5]}/img-mean-std-{s}.npy").ravel())
        assert len(r["cls"]) == 2 and r["patch_shape"] == [4, 2]
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    reading = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    assert all("latents#" not in x and "patches#" not in x for x in lines[reading + 1:] if "Exchange" in x)
    assert not any("Exchange" in x or "Join" in x for x in lines[:reading])
