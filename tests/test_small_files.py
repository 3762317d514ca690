"""Folders of many small files: listings and scans."""
import numpy as np
import pytest

from featurelab import session
from featurelab.operators.images import read_images
from featurelab.sinks.writers import png_bytes
from featurelab.sources import files as S


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for k in range(400):
        (root / f"class_{k % 2}").mkdir(exist_ok=True)
        (root / f"class_{k % 2}" / f"img {k}.png").write_bytes(png_bytes(bytes([k % 256] * 12), 2, 2))
    np.save(root / "class_0" / "a.npy", np.arange(3.0))
    deep = root / "class_0" / "deep" / "er"
    deep.mkdir(parents=True)
    for name in ("x.png", ".hidden.png", "_skipped.png", "_k=1.png"):
        (deep / name).write_bytes(png_bytes(bytes(12), 2, 2))
    (root / "top.png").write_bytes(png_bytes(bytes(12), 2, 2))
    (root / "_rejected").mkdir()
    (root / "_rejected" / "gone.png").write_bytes(b"1")
    return str(root)


def test_listing_is_what_spark_lists_in_few_tasks(spark, folder):
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    got = S.list_files(spark, folder)
    assert got.rdd.getNumPartitions() <= 8 < want.rdd.getNumPartitions()
    assert sorted(map(tuple, got.select("path", "length").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r[0] for r in got.select("rel_path").collect())[-1] == "top.png"


def test_patterns_take_the_files_of_their_depth_in_few_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "default_parallelism", lambda _spark: 1)
    images = read_images(spark, folder + "/*/*.png", keep_invalid=True)
    assert images.rdd.getNumPartitions() <= 4
    want = spark.read.format("image").load(folder + "/*/*.png").select("image.origin")
    assert sorted(r[0] for r in images.select("path").collect()) == sorted(r[0] for r in want.collect())
    assert [r["values"] for r in S.ingest_arrays(spark, folder + "/*/*.npy").collect()] == [[0.0, 1.0, 2.0]]
    assert S.ingest_arrays(spark, folder + "/class_0/a.npy").count() == 1


def test_a_folder_is_looked_at_without_listing_what_is_below(spark, folder, monkeypatch):
    monkeypatch.setattr(type(spark), "read", property(lambda _s: pytest.fail("the folder was listed by the driver")))
    assert S.path_exists(spark, folder) and S.manifest_files(spark, folder) == []
