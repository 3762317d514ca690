"""Writing datasets, manifests, evaluation reports and metric logs.

Tables are written through Spark's file commit protocol.  Artifacts written as
plain files by the tasks (images, arrays, manifests) go to a name of the task
attempt's own first and are renamed when complete (O3), so a killed or
speculative task never leaves part of a file under the final name.
"""
from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import artifact_path
from ..operators.labels import all_or_nothing_labels

# Rows of one manifest document; a manifest of more rows is several documents.
MANIFEST_ROWS = 50_000
REPORT_LINES = ("Inception Score", "FID", "sFID", "Precision", "Recall")


def png_bytes(pixels: bytes, width: int, height: int, channels: int = 3) -> bytes:
    """Encode interleaved uint8 pixels as an uncompressed (level 0) PNG."""
    color = {1: 0, 3: 2, 4: 6}[channels]
    stride = width * channels
    raw = b"".join(b"\x00" + pixels[y * stride:(y + 1) * stride] for y in range(height))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    ihdr = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def write_dataset(df: DataFrame, dest: str, idx_col: str = "idx", mode: str = "errorifexists") -> None:
    """O1: rows keyed by ``archive_path`` (``00000/img00000000.png``), partitioned by
    the 5-digit prefix.  The destination must not exist (``errorifexists``)."""
    out = df.withColumn("archive_path", artifact_path(idx_col, "image")) \
        .withColumn("prefix", F.substring(F.format_string("%08d", F.col(idx_col)), 1, 5))
    out.repartition("prefix").write.mode(mode).partitionBy("prefix").parquet(dest)


def manifest_frame(df: DataFrame, name_col: str = "archive_path", label_col: str = "label") -> DataFrame:
    """O2 (column form): ``(name, label)`` rows with the all-or-nothing rule applied."""
    return all_or_nothing_labels(df.select(F.col(name_col).alias("name"), F.col(label_col).alias("label")), "label")


def local_root(dest: str) -> str:
    """The mounted folder of a destination for files written by the tasks."""
    return dest[len("file:"):] if dest.startswith("file:") else dest


def write_file(path: str, data: bytes) -> None:
    """O3: write under a name of this attempt's own, then rename."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "wb") as fh:
        fh.write(data)
    os.replace(own, path)


def write_manifest(df: DataFrame, dest: str, name_col: str = "archive_path", label_col: str = "label",
                   documents: bool = False, idx_col: str = "idx", rows: int = MANIFEST_ROWS) -> None:
    """O2: the manifest.  JSON lines per partition by default; ``documents`` writes
    files ``dest/dataset-NNNNN.json`` of ``{"labels": [[name, label], ...] | null}``,
    in index order, ``rows`` rows each, in parallel: what :func:`scan_images` reads."""
    m = manifest_frame(df.select(idx_col, name_col, label_col), name_col, label_col)
    if not documents:
        m.write.mode("errorifexists").json(dest)
        return
    labelled = df.agg(F.coalesce(F.bool_and(F.col(label_col).isNotNull()), F.lit(True)).alias("a")).first()["a"]
    root = local_root(dest)
    shard = F.floor(F.col(idx_col) / F.lit(rows)).cast("long")
    src = df.select(shard.alias("shard"), F.col(idx_col).alias("idx"), F.col(name_col).alias("name"), F.to_json(
        F.struct(F.col(label_col).alias("v"))).alias("label")).where("name is not null")

    def write(key, pdf):
        import pandas as pd
        pairs = [[n, json.loads(v).get("v")] for n, v in zip(pdf.sort_values("idx")["name"], pdf.sort_values("idx")["label"])]
        write_file(os.path.join(root, f"dataset-{int(key[0]):05d}.json"),
                   json.dumps({"labels": pairs if labelled else None}).encode())
        return pd.DataFrame({"shard": [int(key[0])], "rows": [len(pairs)]})

    # one group is one document of at most `rows` rows
    written = src.groupBy("shard").applyInPandas(write, "shard long, rows long").agg(F.sum("rows")).first()[0]
    if not written:  # an empty dataset has a manifest too
        write_file(os.path.join(root, "dataset-00000.json"), json.dumps({"labels": []}).encode())


def report_text(numbers: dict) -> str:
    """The five report lines."""
    return "".join(f"{k}: {numbers[k]}\n" for k in REPORT_LINES)


def write_eval_report(spark: SparkSession, numbers: dict, dest: str) -> None:
    """Five-line text report (one small file through the commit protocol)."""
    lines = [(f"{k}: {numbers[k]}",) for k in REPORT_LINES]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(dest)


def write_metrics(df: DataFrame, dest: str, run: str) -> None:
    """Append step metrics, partitioned by run."""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(dest)


def write_image_files(df: DataFrame, dest: str, idx_col: str = "idx", image_col: str = "image") -> DataFrame:
    """O1 as files: each image becomes ``dest/<first 5 digits>/img<8 digits>.png``
    (uncompressed PNG), written by the task holding it.  Names are a function
    of the index, so a retried task replaces its own files.  Needs ``dest``
    mounted on the executors (POSIX path).  Returns ``(idx, archive_path,
    width, height, error)``, lazily: every action writes again, so stage it
    once (:func:`featurelab.session.stage`).  Rows without an image (P3) have a
    null path and keep their ``error``."""
    import pandas as pd

    root = local_root(dest)
    has_error = "error" in df.columns

    def write(batches):
        for pdf in batches:
            out = []
            for idx, im, error in zip(pdf[idx_col], pdf[image_col], pdf["error"]):
                if im is None:
                    out.append((idx, None, None, None, error or "missing or undecodable image"))
                    continue
                s = f"{int(idx):08d}"
                rel = f"{s[:5]}/img{s}.png"
                w, h, channels = (int(im[c]) for c in ("width", "height", "nChannels"))  # floats where the column has nulls
                write_file(os.path.join(root, rel), png_bytes(bytes(im["data"]), w, h, channels))
                out.append((idx, rel, w, h, None))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate(
                [(idx_col, "int64"), ("archive_path", "object"), ("width", "Int32"), ("height", "Int32"), ("error", "object")])})

    key_type = df.schema[idx_col].dataType.simpleString()
    error = F.col("error") if has_error else F.lit(None).cast("string").alias("error")
    return df.select(idx_col, image_col, error).mapInPandas(
        write, f"{idx_col} {key_type}, archive_path string, width int, height int, error string")


def write_array_files(df: DataFrame, dest: str, kind: str = "latents", idx_col: str = "idx",
                      values_col: str = "features", shape: tuple | None = None,
                      dtype: str = "float32") -> DataFrame:
    """Per-row ``.npy`` artifacts named by the index (``artifact_path`` kinds
    ``latents``, ``cls``, ``patches``), written by the task holding the row;
    deterministic names make retries replace them.  Returns ``(idx,
    artifact_path)``, lazily (see :func:`write_image_files`)."""
    return write_array_sets(df, dest, [(kind, values_col, shape)], idx_col, dtype).withColumnRenamed(kind, "artifact_path")


def write_array_sets(df: DataFrame, dest: str, sets: list[tuple[str, str, tuple | None]], idx_col: str = "idx",
                     dtype: str = "float32") -> DataFrame:
    """Several ``.npy`` artifacts per row in one pass: ``sets`` lists ``(kind,
    column, shape)``.  Returns the index and one path column per kind."""
    import io as _io

    import numpy as np
    import pandas as pd

    from ..functions.paths import ARTIFACT_FORMATS

    root = local_root(dest)

    def write(batches):
        for pdf in batches:
            paths: dict = {kind: [] for kind, _, _ in sets}
            for kind, column, shape in sets:
                for idx, vals in zip(pdf[idx_col], pdf[column]):
                    s = f"{int(idx):08d}"
                    rel = f"{s[:5]}/" + (ARTIFACT_FORMATS[kind] % s)
                    arr = np.asarray(vals, dtype=dtype)
                    buf = _io.BytesIO()
                    np.save(buf, arr if shape is None else arr.reshape(shape))
                    write_file(os.path.join(root, rel), buf.getvalue())
                    paths[kind].append(rel)
            yield pd.DataFrame({idx_col: pdf[idx_col].values, **paths})

    key_type = df.schema[idx_col].dataType.simpleString()
    columns = ", ".join(f"{kind} string" for kind, _, _ in sets)
    return df.select(idx_col, *(c for _, c, _ in sets)).mapInPandas(write, f"{idx_col} {key_type}, {columns}")


def write_array_batches(df: DataFrame, dest: str, idx_col: str = "index", values_col: str = "pixels",
                        shape: tuple = (8, 8, 3), member: str = "arr_0", rows_per_file: int = 1024,
                        dtype: str = "uint8") -> DataFrame:
    """The sample batch as ``.npz`` shards: rows of a task, in index order, are
    stacked into ``member`` (``[n, *shape]``) in files of at most
    ``rows_per_file`` rows named by their first index (retries overwrite).
    The inverse of :func:`featurelab.sources.files.ingest_array_batches`; no
    task ever holds more than one shard.  Returns ``(file, first_index, rows)``."""
    import io as _io

    import numpy as np
    import pandas as pd

    root = local_root(dest)

    def write(batches):
        rows, index = [], []

        def flush():
            if not rows:
                return None
            name = f"samples-{int(index[0]):09d}.npz"
            buf = _io.BytesIO()
            np.savez(buf, **{member: np.stack(rows).astype(dtype).reshape((len(rows),) + tuple(shape))})
            write_file(os.path.join(root, name), buf.getvalue())
            out = (name, int(index[0]), len(rows))
            rows.clear()
            index.clear()
            return out

        done = []
        for pdf in batches:
            for i, v in zip(pdf[idx_col], pdf[values_col]):
                rows.append(np.asarray(v))
                index.append(i)
                if len(rows) >= rows_per_file:
                    done.append(flush())
        last = flush()
        if last:
            done.append(last)
        if done:
            yield pd.DataFrame(done, columns=["file", "first_index", "rows"])

    ordered = df.select(idx_col, values_col).repartitionByRange(F.col(idx_col)).sortWithinPartitions(idx_col)
    return ordered.mapInPandas(write, "file string, first_index long, rows long")
