"""Run a user-supplied model over rows in Arrow batches.

``make_predict_fn`` is called once per Python worker (the model loads once
and is reused across batches and tasks); the returned function maps a numpy
batch to a numpy batch.  Models are brought by the user (no weights ship
here): encoders for pixels to latents or tokens, feature extractors for the
evaluation, or the denoiser for a sampler step.
"""
from __future__ import annotations

import uuid
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MODELS: dict = {}


def batch_score(make_predict_fn: Callable, return_type: T.DataType = T.ArrayType(T.DoubleType()),
                batch_size: int = 256, input_tensor_shapes=None) -> Callable[..., Column]:
    """N1 column form: ``predict_batch_udf`` (one model per worker, batched calls)."""
    return predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                             input_tensor_shapes=input_tensor_shapes)


def score_in_pandas(df: DataFrame, make_predict_fn: Callable, input_col: str, schema: str,
                    keep_cols: list[str] = (), batch_size: int = 256) -> DataFrame:
    """N1 multi-output form: ``predict(x: ndarray) -> dict[name, ndarray]`` per batch."""
    key = ("predict", uuid.uuid4().hex)  # fixed on the driver: one model per worker per operator
    keep = list(keep_cols)

    def run(batches):
        fn = _MODELS.get(key)
        if fn is None:
            fn = _MODELS[key] = make_predict_fn()
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                x = np.vstack(part[input_col].values).astype(np.float32)
                out = fn(x)
                cols = {c: part[c].values for c in keep}
                for name, arr in out.items():
                    arr = np.asarray(arr)
                    cols[name] = list(arr) if arr.ndim > 1 else arr
                yield pd.DataFrame(cols)

    return df.select(*keep, input_col).mapInPandas(run, schema)


def softmax_head(columns: int, temperature: float = 20.0) -> Callable:
    """A tiny example model: softmax of ``temperature * x[:, :columns]`` (a linear head)."""
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            z = x[:, :columns].astype(np.float64) * temperature
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            return e / e.sum(axis=1, keepdims=True)
        return predict
    return make


def with_scores(df: DataFrame, udf, input_col: str, out_col: str) -> DataFrame:
    return df.withColumn(out_col, udf(F.col(input_col)))


def encode_images(df: DataFrame, make_encoder: Callable, key_col: str, dim: int,
                  image_col: str = "image", batch_size: int = 64) -> DataFrame:
    """N1, pixels to features: ``encoder(uint8[B, H, W, C]) -> float[B, dim]``.

    Images of a batch are stacked when they share a size (after G5 they do),
    else encoded one by one.  The encoder loads once per Python worker.
    """
    key = ("encoder", uuid.uuid4().hex)  # fixed on the driver: one encoder per worker per operator
    key_type = df.schema[key_col].dataType.simpleString()

    def run(batches):
        fn = _MODELS.get(key)
        if fn is None:
            fn = _MODELS[key] = make_encoder()
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                arrs = [np.frombuffer(im["data"], dtype=np.uint8).reshape(im["height"], im["width"], im["nChannels"])
                        for im in part[image_col]]
                if arrs and all(a.shape == arrs[0].shape for a in arrs):
                    feats = np.asarray(fn(np.stack(arrs)), dtype=np.float64).reshape(len(arrs), dim)
                else:
                    feats = np.vstack([np.asarray(fn(a[None]), dtype=np.float64).reshape(1, dim) for a in arrs])
                yield pd.DataFrame({key_col: part[key_col].values, "features": list(feats)})

    return df.select(key_col, image_col).mapInPandas(run, f"{key_col} {key_type}, features array<double>")


def pixel_sum_encoder() -> Callable:
    """A stand-in encoder for checks: one feature, the sum of all pixel values."""
    def make():
        return lambda x: x.reshape(x.shape[0], -1).sum(axis=1, dtype=np.int64)[:, None].astype(np.float64)
    return make


def channel_moments_encoder() -> Callable:
    """A stand-in encoder for checks: per-channel mean then per-channel population
    std of each image (``2C`` values, the packed mean/std layout)."""
    def make():
        def enc(x):
            f = x.astype(np.float64).reshape(x.shape[0], -1, x.shape[-1])
            return np.concatenate([f.mean(axis=1), f.std(axis=1)], axis=1)
        return enc
    return make


def quadrant_token_encoder():
    """A stand-in token encoder: nine tokens of width 2 per image - the mean, four
    registers (zero), and for each quadrant its (mean, last pixel) of channel 0."""
    def make():
        def encode(x):
            c = np.asarray(x, dtype=np.float64)[..., 0]
            h, w = c.shape[1] // 2, c.shape[2] // 2
            out = np.zeros((len(c), 9, 2))
            out[:, 0] = c.mean(axis=(1, 2))[:, None]
            for k, q in enumerate((c[:, :h, :w], c[:, :h, w:], c[:, h:, :w], c[:, h:, w:])):
                out[:, 5 + k] = np.stack([q.mean(axis=(1, 2)), q[:, -1, -1]], axis=1)
            return out.reshape(len(c), -1)
        return encode
    return make
