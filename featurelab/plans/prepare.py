"""The dataset-conversion and encoding flows.

convert: scan (S1 / S2, with W2/S4 labels and P2) -> decode (Spark's image
source, RGB) -> crop and resample (G5) -> PNG files under 5-digit prefixes
(O1).  These run as one pass whose output, the listing of what was written, is
staged; the quarantine (P3), the uniform power-of-two square check (P4) and
the manifest with the all-or-nothing label rule (O2 / P8) come from the
listing, so each image is transformed and written exactly once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import read_images, transform_images
from ..operators.align import missing_siblings
from ..operators.labels import assert_uniform_square, attach_labels, read_label_manifest
from ..operators.position import with_position
from ..operators.scoring import encode_images
from ..session import stage
from ..sinks.archives import write_image_archives
from ..sinks.writers import write_array_sets, write_image_files, write_manifest
from ..sources.files import (list_files, manifest_files, open_dataset, path_exists, read_array_files, scan_feature_set, scan_images,
                              unpack_archives)


def _empty_folder(spark: SparkSession, dest: str) -> None:
    """O1: the destination folder must not hold files."""
    if path_exists(spark, dest) and list_files(spark, dest).limit(1).count():
        raise ValueError(f"destination folder is not empty: {dest}")


#: up to so many listed paths (some hundred bytes each) are broadcast to the decoder, beyond it all files are decoded
BROADCAST_PATHS = 100_000


def convert_dataset(spark: SparkSession, source: str, dest: str, transform: str | None = None,
                    width: int | None = None, height: int | None = None,
                    max_images: int | None = None) -> DataFrame:
    """Convert ``source`` (an image folder, or ``.zip`` archives) into ``dest``, a folder or,
    ending in ``.zip``, archives (:mod:`featurelab.sinks.archives`); returns the written rows
    ``(idx, archive_path, label)``.  Images that do not decode or are rejected go to
    ``dest/_rejected`` (``<dest>_rejected`` beside archives) as ``(idx, source, error)``.

    Images are cropped and resampled where they are decoded; only the results meet
    their index."""
    archives = dest.endswith(".zip")
    if not archives:
        _empty_folder(spark, dest)
    listed = open_dataset(spark, source, max_images)
    if "member" in listed.columns:
        listed, folder = unpack_archives(spark, listed)
    else:
        folder = source
    # the listing and the decoder may spell file URIs differently: join on the bare path
    bare = lambda c: F.regexp_replace(F.col(c), "^file:/*", "/")
    listed = stage(listed.select("idx", bare("path").alias("source"), "label"), "convert-listing")

    def shrink(images: DataFrame) -> DataFrame:
        pixels = images.select(bare("path").alias("source"), "image")
        if max_images is not None and max_images <= BROADCAST_PATHS:
            pixels = pixels.join(F.broadcast(listed.select("source")), "source", "left_semi")
        return transform_images(pixels, transform, width, height, key_col="source")

    done = read_images(spark, folder, "path", recursive=True, keep_invalid=True, then=shrink)
    rows = listed.join(done, "source", "left")
    if archives:
        written = write_image_archives(rows, dest)
    else:
        written = stage(write_image_files(rows.select("idx", "image", "error"), dest), "convert-written")
    written = written.join(listed, "idx")
    rejected = dest[:-len(".zip")] + "_rejected" if archives else dest.rstrip("/") + "/_rejected"
    written.where("archive_path is null").select("idx", "source", "error").write.mode("overwrite").parquet(rejected)
    good = written.where("archive_path is not null")
    assert_uniform_square(good.select("idx", F.col("width").alias("w"), F.col("height").alias("h")))
    good = good.select("idx", "archive_path", "label")
    if not archives:
        write_manifest(good, dest, documents=True)
    return good


def _encoded(spark: SparkSession, converted: str, make_encoder, dim: int) -> DataFrame:
    """``idx, features`` of a converted folder."""
    def encode(imgs: DataFrame) -> DataFrame:
        imgs = imgs.select(F.regexp_extract("path", r"img(\d{8})\.png$", 1).cast("bigint").alias("idx"), "image")
        return encode_images(imgs, make_encoder, "idx", dim)
    return read_images(spark, converted, "path", recursive=True, then=encode)


def _with_labels(spark: SparkSession, converted: str, dest: str, written: DataFrame, name_col: str) -> DataFrame:
    """Carry the labels of the converted manifest into ``dest``."""
    names = manifest_files(spark, converted)
    if names:
        labels = read_label_manifest(spark, names).select(
            F.regexp_extract("name", r"img(\d{8})\.png$", 1).cast("bigint").alias("idx"), "label")
        out = written.join(labels, "idx", "left")
    else:
        out = written.withColumn("label", F.lit(None).cast("int"))
    write_manifest(out, dest, name_col, documents=True)
    return out


def encode_dataset(spark: SparkSession, converted: str, dest: str, make_encoder, dim: int,
                   kind: str = "latents", shape: tuple | None = None, dtype: str = "float32") -> DataFrame:
    """Encode a converted folder: decode its PNGs, run the user encoder (N1) in
    Arrow batches, write ``<prefix>/img-mean-std-<idx>.npy`` (or token files),
    and carry the labels of the converted manifest into ``dest``.  Each image
    is encoded exactly once.  Returns ``(idx, artifact_path, label)``."""
    feats = _encoded(spark, converted, make_encoder, dim)
    written = stage(write_array_sets(feats, dest, [(kind, "features", shape)], dtype=dtype), "encode-written")
    return _with_labels(spark, converted, dest, written.withColumnRenamed(kind, "artifact_path"), "artifact_path")


def encode_tokens_dataset(spark: SparkSession, converted: str, dest: str, make_encoder, tokens: int,
                          width: int, registers: int = 4, dtype: str = "float32") -> DataFrame:
    """Token encoding: the encoder returns hidden states ``[1 + R + N, D]`` per image
    (flattened); the class token (V4: ``h[0]``) goes to ``..._cls.npy`` and the
    patch tokens (``h[1 + R:]``) to ``..._patches.npy``, register tokens dropped;
    both are written in the pass that encodes.  The manifest names the class
    files.  Returns ``(idx, cls_path, patches_path, label)``."""
    hidden = _encoded(spark, converted, make_encoder, tokens * width)
    n_patches = tokens - 1 - registers
    split = hidden.select("idx", F.slice("features", 1, width).alias("cls_values"),
                          F.slice("features", (1 + registers) * width + 1, n_patches * width).alias("patch_values"))
    sets = [("cls", "cls_values", None), ("patches", "patch_values", (n_patches, width))]
    written = stage(write_array_sets(split, dest, sets, dtype=dtype), "tokens-written")
    written = written.withColumnsRenamed({"cls": "cls_path", "patches": "patches_path"})
    return _with_labels(spark, converted, dest, written, "cls_path")


def load_training_set(spark: SparkSession, images: str, latents: str, tokens: str | None = None,
                      vector_labels: bool = False) -> DataFrame:
    """The training set of written artifacts, aligned by sorted position.

    ``(idx, image, label, latents, latent_shape)`` and, with ``tokens``,
    ``cls, patches, patch_shape``; arrays are row-major values.  Names and labels
    are joined first, then each task opens the files of its rows, so no array is
    exchanged.  It is an error
    if the folders hold different numbers of samples, if the latents' manifest
    is missing or leaves a file without a label (J2), or if a class file has no
    patches (J3).
    """
    img = scan_images(spark, images, use_dir_labels=False).select("idx", F.col("rel_path").alias("image"))
    lat = with_position(list_files(spark, latents).where(F.lower("rel_path").endswith(".npy")), "rel_path", "idx").select("idx", "rel_path", "path")
    sides = {"images": img, "latents": lat}
    if tokens:
        sides["tokens"] = tok = scan_feature_set(spark, tokens).select("idx", F.col("path").alias("cls_file"), "sibling")
        lone = missing_siblings(*[list_files(spark, tokens).select(F.col("rel_path").alias("path"))] * 2).limit(5).collect()
        if lone:
            raise FileNotFoundError(f"class files without patches: {[r[0] for r in lone]}")
    counts = {name: df.count() for name, df in sides.items()}
    if len(set(counts.values())) != 1:
        raise ValueError(f"the folders hold different numbers of samples: {counts}")
    names = manifest_files(spark, latents)
    if not names:
        raise FileNotFoundError(f"no dataset.json in {latents}")
    labels = read_label_manifest(spark, names, vectors=vector_labels).withColumnRenamed("name", "rel_path")
    lat = attach_labels(lat, labels, "rel_path", strict=True)
    out = img.join(lat.select("idx", "label", F.col("path").alias("_latents")), "idx")
    wanted = {"_latents": ("latents", "latent_shape")}
    if tokens:
        out = out.join(tok.withColumnsRenamed({"cls_file": "_cls", "sibling": "_patches"}), "idx")
        wanted |= {"_cls": ("cls", "cls_shape"), "_patches": ("patches", "patch_shape")}
    out = read_array_files(out, wanted).drop(*wanted)
    return out.drop("cls_shape")
