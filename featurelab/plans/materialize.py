"""Derive file inputs (image folders, archives, array files, manifests) from the tables.

The file-based operators read files; these jobs write such files from the
driver tables so the reads can be checked against SQL over the same rows.
Files are written by the tasks into a fresh folder under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster).  Each embedding row
becomes an 8 x 8 grey image (``floor((v + 1) * 127.5)`` per value, three equal
channels) in folder ``class_<label>``.
"""
from __future__ import annotations

import io
import json
import os
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sinks.writers import png_bytes, write_file
from . import fixtures as fx

SIDE = 8


def fresh_folder(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark)
    root = root[len("file:"):] if root.startswith("file:") else root
    path = os.path.join(root, "files", f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def pixels_of(values) -> np.ndarray:
    g = np.floor((np.asarray(values, dtype=np.float64) + 1.0) * 127.5).astype(np.uint8).reshape(SIDE, SIDE)
    return np.repeat(g[:, :, None], 3, axis=2)


def _emb(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def write_image_folder(spark: SparkSession, sf: str, with_manifest: bool = False, copies: int = 0, odd: bool = False) -> str:
    """PNG files ``class_<label>/img_<vec_id>.png`` (plus ``dataset.json`` if asked);
    with ``copies`` that many ``img_<vec_id>_<k>.png`` each.  ``odd``: by the
    last digit of the id, 3 is no image, 4 has one channel, 5 has four."""
    root = fresh_folder(spark, "images")

    def image(vid, emb):
        px = pixels_of(emb)
        if odd and vid % 10 == 3:
            return b"no image"
        if odd and vid % 10 == 4:
            return png_bytes(np.ascontiguousarray(px[:, :, :1]).tobytes(), SIDE, SIDE, 1)
        if odd and vid % 10 == 5:
            return png_bytes(np.concatenate([px, np.full((SIDE, SIDE, 1), 200, np.uint8)], axis=2).tobytes(), SIDE, SIDE, 4)
        return png_bytes(px.tobytes(), SIDE, SIDE, 3)

    def write(batches):
        n = 0
        for pdf in batches:
            for vid, emb, lab in zip(pdf["vec_id"], pdf["embedding"], pdf["label"]):
                for k in range(copies) if copies else [None]:
                    name = f"img_{vid}.png" if k is None else f"img_{vid}_{k}.png"
                    write_file(os.path.join(root, f"class_{lab}", name), image(vid, emb))
                    n += 1
        yield pd.DataFrame({"n": [n]})

    _emb(spark, sf).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    if with_manifest:
        write_manifest_json(spark, sf, root)
    return root


def write_manifest_json(spark: SparkSession, sf: str, folder: str, shards: int = 4) -> None:
    """Label manifests for the image folder (label = vec_id mod 7), one
    ``{"labels": [[name, label], ...]}`` document per shard
    ``dataset-<shard>.json`` (shard = vec_id mod ``shards``), written by the
    task that holds the shard, so no task holds the whole manifest."""
    e = _emb(spark, sf).select("vec_id", "label").repartition(shards, F.pmod("vec_id", F.lit(shards)))

    def write(batches):
        by_shard: dict = {}
        for pdf in batches:
            for vid, lab in zip(pdf["vec_id"], pdf["label"]):
                by_shard.setdefault(int(vid) % shards, []).append(
                    (int(vid), [f"class_{lab}/img_{vid}.png", int(vid) % 7]))
        for shard, pairs in by_shard.items():
            pairs.sort()
            with open(os.path.join(folder, f"dataset-{shard:05d}.json"), "w") as fh:
                json.dump({"labels": [p for _, p in pairs]}, fh)
        yield pd.DataFrame({"n": [len(by_shard)]})

    e.mapInPandas(write, "n long").collect()


def write_archives(spark: SparkSession, sf: str, shards: int = 2) -> str:
    """Zip archives ``label_<k>_<s>.zip`` (shard s = vec_id mod ``shards``) holding
    ``img_<vec_id>.png`` members and a ``dataset.json`` (label = vec_id mod 3).
    Sharding keeps a hot label from becoming one huge single-task archive."""
    root = fresh_folder(spark, "archives")
    key = F.concat_ws("_", F.col("label").cast("string"), F.pmod("vec_id", F.lit(shards)).cast("string"))
    e = _emb(spark, sf).withColumn("_arc", key).repartition(F.col("_arc"))

    def write(batches):
        groups: dict = {}
        for pdf in batches:
            for vid, emb, arc in zip(pdf["vec_id"], pdf["embedding"], pdf["_arc"]):
                groups.setdefault(arc, []).append((int(vid), emb))
        for arc, rows in groups.items():
            with zipfile.ZipFile(os.path.join(root, f"label_{arc}.zip"), "w") as z:
                pairs = []
                for vid, emb in sorted(rows):
                    z.writestr(f"img_{vid}.png", png_bytes(pixels_of(emb).tobytes(), SIDE, SIDE, 3))
                    pairs.append([f"img_{vid}.png", vid % 3])
                z.writestr("dataset.json", json.dumps({"labels": pairs}))
        yield pd.DataFrame({"n": [len(groups)]})

    e.mapInPandas(write, "n long").collect()
    return root


def write_npy_files(spark: SparkSession, sf: str) -> str:
    """``vec_<id>_cls.npy`` (the embedding, float32) and, for ids not divisible by 11,
    ``vec_<id>_patches.npy`` (4 x 16 reshaped)."""
    root = fresh_folder(spark, "npy")

    def write(batches):
        n = 0
        for pdf in batches:
            for vid, emb in zip(pdf["vec_id"], pdf["embedding"]):
                a = np.asarray(emb, dtype=np.float32)
                np.save(os.path.join(root, f"vec_{vid}_cls.npy"), a)
                if vid % 11 != 0:
                    np.save(os.path.join(root, f"vec_{vid}_patches.npy"), a.reshape(4, 16))
                n += 1
        yield pd.DataFrame({"n": [n]})

    _emb(spark, sf).mapInPandas(write, "n long").collect()
    return root


NPZ_ROWS = 256


def write_npz_batches(spark: SparkSession, sf: str, parity: int | None = None) -> str:
    """``part_<p>.npz`` with member ``arr_0`` of shape ``[N_p, 65]``: vec_id then the
    embedding, ``NPZ_ROWS`` ids per file (of ids of one ``parity``, if given)."""
    root = fresh_folder(spark, "npz")
    e = _emb(spark, sf) if parity is None else _emb(spark, sf).where(F.pmod("vec_id", F.lit(2)) == parity)
    e = e.withColumn("part", F.floor(F.col("vec_id") / F.lit(NPZ_ROWS)))

    def write(key, pdf):
        pdf = pdf.sort_values("vec_id")
        arr = np.column_stack([pdf["vec_id"].to_numpy(np.float64), np.vstack(pdf["embedding"].tolist()).astype(np.float64)])
        buf = io.BytesIO()
        np.savez(buf, arr_0=arr)
        write_file(os.path.join(root, f"part_{int(key[0]):06d}.npz"), buf.getvalue())  # a retried task replaces its file
        return pd.DataFrame({"n": [len(arr)]})

    e.groupBy("part").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return root
