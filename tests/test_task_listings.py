"""Folders of more files than the driver may list."""
import numpy as np
import pytest
from pyspark.sql.readwriter import DataFrameReader

from featurelab.operators import scoring as SC
from featurelab.operators.images import read_images
from featurelab.plans.prepare import convert_dataset, encode_dataset, encode_tokens_dataset, load_training_set
from featurelab.sinks.writers import png_bytes
from featurelab.sources import files as S
from featurelab.sources import listing

ODD = ("a b.png", "c%20d.png", "x[1].png", "{y}.png", "q?.png", "s*.png", "e#f.png", "ü.png", "back\\slash.png")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("large")
    for k in range(90):
        (root / f"class_{k % 3}").mkdir(exist_ok=True)
        (root / f"class_{k % 3}" / f"img{k}.png").write_bytes(png_bytes(bytes([k] * 48), 4, 4))
    for k, name in enumerate(ODD):
        (root / "class_1" / name).write_bytes(png_bytes(bytes([100 + k] * 12), 2, 2))
    (root / "class_2" / "grey.png").write_bytes(png_bytes(bytes([7] * 16), 4, 4, 1))
    (root / "class_2" / "bad.png").write_bytes(b"no image")
    (root / "class_2" / "empty.png").write_bytes(b"")
    (root / "class_2" / "_skipped.png").write_bytes(png_bytes(bytes(12), 2, 2))
    (root / "_hidden").mkdir()
    (root / "_hidden" / "h.png").write_bytes(png_bytes(bytes(12), 2, 2))
    for k in range(60):
        np.save(root / "class_0" / f"a{k}.npy", np.full((2, k % 3 + 1), k, np.float32))
    return str(root)


@pytest.fixture
def few(monkeypatch):
    """The driver may list 25 files; yields the numbers of files of all scans."""
    listed, load = [], DataFrameReader.load

    def counted(self, path=None, *args, **kw):
        df = load(self, path, *args, **kw)
        names = path if isinstance(path, list) else [path]
        if not any("/staged/" in str(x) for x in names):
            listed.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(listing, "DRIVER_FILES", 25)
    monkeypatch.setattr(DataFrameReader, "load", counted)
    return listed


def _rows(df):
    return sorted((r["path"], r["image"] and (r["image"]["height"], bytes(r["image"]["data"]))) for r in df.collect())


@pytest.mark.parametrize("keep", [False, True])
def test_images_are_read_in_groups(spark, folder, few, monkeypatch, keep):
    want = {}
    with monkeypatch.context() as m:
        m.setattr(listing, "DRIVER_FILES", 1000)
        for paths, recursive in ((folder, True), (folder + "/*/*.png", False), (folder + "/class_?/img*.png", False)):
            want[paths] = _rows(read_images(spark, paths, recursive=recursive, keep_invalid=keep))
    few.clear()
    for paths, rows in want.items():
        assert _rows(read_images(spark, paths, recursive=paths == folder, keep_invalid=keep)) == rows and len(rows) >= 90
    assert few and max(few) <= 50  # groups by hash, of 25 about


def test_arrays_are_read_by_tasks(spark, folder, few):
    key = lambda r: (r["path"], tuple(r["shape"]), r["dtype"], tuple(r["values"]))
    got = sorted(map(key, S.ingest_arrays(spark, folder + "/*/*.npy").collect()))
    assert not few
    listing.DRIVER_FILES = 1000
    assert got == sorted(map(key, S.ingest_arrays(spark, folder + "/*/*.npy").collect())) and len(got) == 60


def test_flows_list_no_more_on_the_driver(spark, folder, few, tmp_path):
    conv, enc, tok = (str(tmp_path / x) for x in ("converted", "encoded", "tokens"))
    done = convert_dataset(spark, folder, conv, "center-crop", 2, 2)
    n = done.count()
    bad = spark.read.parquet(conv + "/_rejected").count()
    encode_dataset(spark, conv, enc, SC.channel_moments_encoder(), 6)
    encode_tokens_dataset(spark, conv, tok, SC.quadrant_token_encoder(), 9, 2)
    rows = load_training_set(spark, conv, enc, tok).collect()
    assert n + bad == 102 and len(rows) == n >= 90 and sorted(r["idx"] for r in rows) == list(range(n))
    assert few and max(few) <= 50
