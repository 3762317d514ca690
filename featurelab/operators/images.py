"""G5 + P3: crop and resample image pixels in Arrow batches, quarantining failures.

Plans (G1-G4) are computed per row from the image size; resampling is the
separable convolution used by common image libraries (support scaled by the
down-scale factor, weights normalised per output pixel) in numpy, one image at
a time inside ``mapInPandas``.  Bit-exact parity with a particular library's
fixed-point kernels is not attempted.  Arrow batches are bounded by bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB by default).

Images are ``struct<height int, width int, nChannels int, data binary>`` with
interleaved channels in RGB order; :func:`from_spark_image` converts Spark's
``image`` source rows (BGR) to that layout.
"""
from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images as G
from ..session import fewer_scan_tasks, load_files
from ..sources.listing import listed_by_tasks, load_groups

IMAGE_STRUCT = "struct<height:int,width:int,nChannels:int,data:binary>"


# ---------------------------------------------------------------- filters
def _box(x):
    return ((x >= -0.5) & (x < 0.5)).astype(np.float64)


def _bicubic(x, a=-0.5):
    # cubic convolution kernel (Keys, 1981)
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1,
                    np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


def _lanczos(x, a=3.0):
    x = np.asarray(x, dtype=np.float64)
    out = np.sinc(x) * np.sinc(x / a)
    return np.where(np.abs(x) < a, out, 0.0)


FILTERS = {"box": (_box, 0.5), "bicubic": (_bicubic, 2.0), "lanczos": (_lanczos, 3.0)}


@functools.lru_cache(maxsize=64)
def resample_weights(n_in: int, n_out: int, kind: str) -> np.ndarray:
    """``(n_out, n_in)`` weights of a 1-D resize; one image size is one cache entry."""
    f, support = FILTERS[kind]
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    center = (np.arange(n_out) + 0.5) * scale
    first = np.maximum((center - support * stretch + 0.5).astype(int), 0)
    last = np.minimum((center + support * stretch + 0.5).astype(int), n_in)
    taps = np.arange(int((last - first).max(initial=1)))
    at = first[:, None] + taps[None, :]
    k = np.where(at < last[:, None], f((at - center[:, None] + 0.5) / stretch), 0.0)
    total = k.sum(axis=1, keepdims=True)
    w = np.zeros((n_out, n_in))
    np.add.at(w, (np.arange(n_out)[:, None], np.minimum(at, n_in - 1)), k / np.where(total == 0, 1.0, total))
    return w


def resize(img: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """Resize an ``(h, w, c)`` array (float) to ``(height, width, c)``."""
    h, w = img.shape[:2]
    x = img.astype(np.float64)
    if w != width:
        x = np.matmul(resample_weights(w, width, kind), x)
    if h != height:
        x = np.tensordot(resample_weights(h, height, kind), x, axes=(1, 0))
    return x


@functools.lru_cache(maxsize=64)
def interpolation_weights(n_in: int, n_out: int) -> np.ndarray:
    """``(n_out, n_in)`` weights of a 1-D cubic interpolation (a = -0.75): four taps around the sample
    point whatever the scale, those beyond the border taken at the border."""
    at = (np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5
    first = np.floor(at).astype(int)
    w = np.zeros((n_out, n_in))
    for tap in range(-1, 3):
        np.add.at(w, (np.arange(n_out), np.clip(first + tap, 0, n_in - 1)), _bicubic(first + tap - at, -0.75))
    return w


def interpolate(img: np.ndarray, side: int) -> np.ndarray:
    """Cubic interpolation of an ``(h, w, c)`` array to ``(side, side, c)``."""
    x = np.matmul(interpolation_weights(img.shape[1], side), img)
    return np.tensordot(interpolation_weights(img.shape[0], side), x, axes=(1, 0))


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- transforms
MODES = (None, "scale", "center-crop", "center-crop-wide", "center-crop-dhariwal")


def validate_transform_args(mode: str | None, width: int | None, height: int | None) -> None:
    """P5: crop modes need a size; the dhariwal crop needs a square one."""
    if mode not in MODES:
        raise ValueError(f"unknown transform {mode!r}; known: {MODES[1:]}")
    if mode and mode.startswith("center-crop") and None in (width, height):
        raise ValueError(f"transform {mode!r} needs both a width and a height")
    if mode == "center-crop-dhariwal" and width != height:
        raise ValueError(f"transform {mode!r} gives squares, not {width}x{height}")


def plan_pixels(mode: str | None, width: int | None, height: int | None, w, h) -> Column:
    """The steps of a transform as one struct column, from the geometry plans G1-G4.

    A box of the source (``top, left, rows, cols``), how often it is halved,
    the size and kernel it is resampled to, the box kept of that, and the
    black canvas it is pasted on (0: none).  ``rejected`` images have no output.
    """
    zero, whole = F.lit(0), {"top": F.lit(0), "left": F.lit(0), "rows": h, "cols": w}
    step = {"halvings": zero, "kernel": F.lit("lanczos"), "keep_top": zero, "keep_left": zero,
            "canvas": zero, "paste": zero, "rejected": F.lit(False)}
    if mode in (None, "scale"):
        g = G.plan_scale(w, h, width, height)
        step |= whole | {"to_cols": g["out_w"], "to_rows": g["out_h"]}
    elif mode == "center-crop":
        g = G.plan_center_crop(w, h, width, height)
        step |= {"top": g["y0"], "left": g["x0"], "rows": g["y1"] - g["y0"], "cols": g["x1"] - g["x0"],
                 "to_cols": g["out_w"], "to_rows": g["out_h"]}
    elif mode == "center-crop-wide":
        g = G.plan_center_crop_wide(w, h, width, height)
        step |= whole | {"top": g["y0"], "rows": g["y1"] - g["y0"], "to_cols": F.lit(int(width)), "to_rows": F.lit(int(height)),
                         "canvas": g["canvas"], "paste": g["paste_y0"], "rejected": g["rejected"]}
    else:
        g = G.plan_dhariwal(w, h, width)
        step |= whole | {"halvings": g["halvings"], "kernel": F.lit("bicubic"), "to_cols": g["resize_w"], "to_rows": g["resize_h"],
                         "keep_top": g["crop_y"], "keep_left": g["crop_x"]}
    keep = F.lit(int(width)) if mode == "center-crop-dhariwal" else F.lit(0)
    step |= {"keep": keep}
    return F.struct(*(c.cast("string" if k == "kernel" else "boolean" if k == "rejected" else "int").alias(k) for k, c in step.items()))


def run_plan(img: np.ndarray, p) -> np.ndarray:
    """Apply one row of :func:`plan_pixels` to an ``(h, w, c)`` uint8 array."""
    x = img[p["top"]:p["top"] + p["rows"], p["left"]:p["left"] + p["cols"]]
    for _ in range(p["halvings"]):
        x = to_uint8(resize(x, x.shape[1] // 2, x.shape[0] // 2, "box"))
    x = to_uint8(resize(x, p["to_cols"], p["to_rows"], p["kernel"]))
    if p["keep"]:
        x = x[p["keep_top"]:p["keep_top"] + p["keep"], p["keep_left"]:p["keep_left"] + p["keep"]]
    if p["canvas"]:
        page = np.zeros((p["canvas"], p["canvas"], x.shape[2]), np.uint8)
        page[p["paste"]:p["paste"] + x.shape[0]] = x
        x = page
    return x


def transform_images(df: DataFrame, mode: str | None, width: int | None, height: int | None,
                     image_col: str = "image", key_col: str = "idx") -> DataFrame:
    """``(key, image, error)``; ``error`` is non-null for rejected, missing or failed rows."""
    validate_transform_args(mode, width, height)

    def run(batches):
        for pdf in batches:
            out, err = [], []
            for im, plan in zip(pdf[image_col], pdf["_plan"]):
                image, error = None, None
                try:
                    if im is None:
                        error = "missing or undecodable image"
                    elif plan["rejected"]:
                        error = "rejected"
                    else:
                        # a column with nulls reaches pandas as floats
                        a = np.frombuffer(im["data"], np.uint8).reshape([int(im[c]) for c in ("height", "width", "nChannels")])
                        r = run_plan(a, {k: v if k == "kernel" else int(v) for k, v in plan.items()})
                        image = {"height": int(r.shape[0]), "width": int(r.shape[1]),
                                 "nChannels": int(r.shape[2]), "data": r.tobytes()}
                except Exception as e:  # noqa: BLE001 - becomes a quarantine row
                    error = f"{type(e).__name__}: {e}"
                out.append(image)
                err.append(error)
            yield pd.DataFrame({key_col: pdf[key_col].values, image_col: out, "error": err})

    key_type = df.schema[key_col].dataType.simpleString()
    # the plans divide by the image size: rows without one get none
    size = [F.when(F.col(image_col)[c] > 0, F.col(image_col)[c]) for c in ("width", "height")]
    plan = F.when(size[0].isNotNull() & size[1].isNotNull(), plan_pixels(mode, width, height, *size))
    return df.select(key_col, image_col, plan.alias("_plan")).mapInPandas(
        run, f"{key_col} {key_type}, {image_col} {IMAGE_STRUCT}, error string")


def drop_failed(transformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (index gaps kept) and the quarantine table."""
    return (transformed.where(F.col("error").isNull()).drop("error"),
            transformed.where(F.col("error").isNotNull()))


def from_spark_image(col: str = "image"):
    """Spark's image source row (BGR bytes) to an RGB image struct column.

    Grey images are repeated to three channels and alpha is dropped, so every
    decoded image has three; an image that did not decode becomes null.
    """
    def convert(im):
        if im is None or im["nChannels"] not in (1, 3, 4) or im["height"] <= 0:
            return None
        h, w, channels = (int(im[c]) for c in ("height", "width", "nChannels"))
        a = np.frombuffer(im["data"], np.uint8).reshape(h, w, channels)
        a = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]
        return {"height": h, "width": w, "nChannels": 3, "data": np.ascontiguousarray(a).tobytes()}

    def swap(batches):
        for pdf in batches:
            yield pdf.assign(**{col: [convert(im) for im in pdf[col]]})
    return swap


def read_images(spark, paths, key_col: str = "path", recursive: bool = False, keep_invalid: bool = False, then=None) -> DataFrame:
    """Decode image files with Spark's ``image`` source; RGB struct + origin path.
    Files that do not decode (manifests, text) are dropped, or with
    ``keep_invalid`` have a null image.  ``then`` (DataFrame to DataFrame) is applied to the
    result; of folders of more files than the driver may list, which are read in groups
    (:func:`featurelab.sources.listing.load_groups`), only what it returns is stored."""

    def reader():
        return spark.read.format("image").option("dropInvalid", not keep_invalid)

    def decoded(raw: DataFrame) -> DataFrame:
        base = fewer_scan_tasks(raw).select(
            F.col("image.origin").alias(key_col),
            F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                     F.col("image.nChannels").alias("nChannels"), F.col("image.data").alias("data")).alias("image"))
        out = base.mapInPandas(from_spark_image("image"), f"{key_col} string, image {IMAGE_STRUCT}")
        return out if then is None else then(out)

    listed = listed_by_tasks(spark, paths, recursive)
    if listed is not None:
        return load_groups(spark, reader, listed, decoded)
    return decoded(load_files(reader().option("recursiveFileLookup", "true") if recursive else reader(), paths))


def image_grid_size(n: int) -> int:
    return round(math.sqrt(n))


#: fixed values: encoder families by the part of their name, with when they resize
_FAMILIES = (("clip", "before"), ("mocov3", None), ("mae", None), ("dinov2", "after"), ("dinov1", None), ("jepa", "after"))


def encoder_inputs(df: DataFrame, family: str, image_col: str = "image", key_col: str = "idx", side: int | None = None) -> DataFrame:
    """Pixels to encoder inputs ``(x / 255 - mean_c) / std_c`` (CLIP statistics for
    ``clip``, ImageNet statistics otherwise), channel-first float arrays.

    ``clip`` is resized (:func:`interpolate`) to ``side``, by default ``224 * (width div 256)``,
    before it is normalised, ``dinov2`` and ``jepa`` after; ``mocov3``, ``mae`` and ``dinov1`` are not
    resized; an unknown family keeps its pixel values.  A target below one pixel
    leaves the size.  The output is ``(key, shape, values)`` with ``shape = [C, H, W]``;
    a null image gives nulls.
    """
    from ..functions.images import CLIP_MEAN, CLIP_STD, IMAGENET_MEAN, IMAGENET_STD, resize_target
    known, when = next(((True, w) for name, w in _FAMILIES if name in family), (False, None))
    mean, std = (CLIP_MEAN, CLIP_STD) if "clip" in family else (IMAGENET_MEAN, IMAGENET_STD)
    m, sd = np.asarray(mean), np.asarray(std)
    key_type = df.schema[key_col].dataType.simpleString()

    def values_of(im) -> np.ndarray:
        h, w, channels = (int(im[c]) for c in ("height", "width", "nChannels"))  # floats where the column has nulls
        x = np.frombuffer(im["data"], dtype=np.uint8).reshape(h, w, channels).astype(np.float64)
        if not known:
            return x
        target = resize_target(w) if side is None else side
        x = x / 255.0
        if when == "before" and target > 0:
            x = interpolate(x, target)
        x = (x - m) / sd
        return interpolate(x, target) if when == "after" and target > 0 else x

    def run(batches):
        for pdf in batches:
            images = [None if im is None else np.transpose(values_of(im), (2, 0, 1)) for im in pdf[image_col]]
            yield pd.DataFrame({key_col: pdf[key_col].values, "shape": [None if x is None else list(x.shape) for x in images],
                                "values": [None if x is None else x.ravel() for x in images]})

    return df.select(key_col, image_col).mapInPandas(
        run, f"{key_col} {key_type}, shape array<int>, values array<double>")
