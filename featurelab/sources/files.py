"""File scans as Spark jobs.

Listings use the ``binaryFile`` source with the ``content`` column pruned, so
only paths and sizes are read until a task needs the bytes.  Archives and stored
arrays are read in ranges (:mod:`featurelab.sources.ranged`): a task reads the
members or rows it needs, Arrow batches out, and no file is one value.

Note: Spark's file index skips names starting with ``_`` or ``.``; such files
are not listed (the source lists every file).
"""
from __future__ import annotations

import io
import json
import os
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.paths import fnmatch_regex, is_image_path
from ..operators.labels import labels_from_top_dir, manifest_label, read_label_manifest
from ..operators.position import with_position
from ..session import default_parallelism, ensure_checkpoint_dir, fewer_scan_tasks, load_files, stage
from .listing import listed_by_tasks, subfolders, walked
from .ranged import Member, StoredArray, array_header, array_rows, local_path, open_ranged, reachable, read_member, stored_array, zip_directory

ARRAY_SCHEMA = "path string, shape array<int>, dtype string, values array<double>"
BATCH_SCHEMA = "path string, member string, row long, shape array<int>, values array<double>"
DEFAULT_ARRAY_BATCH = 64


def _strip_root(path_col, root: str):
    r = root.rstrip("/") + "/"
    p = F.regexp_replace(path_col, "^file:(//)?", "")
    return F.when(p.startswith(r), F.substring(p, len(r) + 1, 1 << 30)).otherwise(p)


def list_files(spark: SparkSession, root: str, ignores: list[str] | None = None,
               add_base_to_relative: bool = False) -> DataFrame:
    """Recursive ``(path, rel_path, length)``; a glob in ``ignores`` prunes any
    directory or file name it matches, at every level."""
    root_abs = os.path.abspath(root) if local_path(root) is not None and "://" not in root else root
    if local_path(root_abs) is not None and os.path.isdir(local_path(root_abs)):
        df = stage(walked(spark, subfolders(local_path(root_abs))), "files")
    else:
        df = fewer_scan_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root_abs).select("path", "length"))
    rel = _strip_root(F.col("path"), local_path(root_abs) or root_abs)
    df = df.withColumn("rel_path", rel)
    for g in ignores or []:
        rx = fnmatch_regex(g)
        df = df.where(~F.exists(F.split("rel_path", "/"), lambda c: c.rlike(rx)))
    if add_base_to_relative:
        base = os.path.basename(os.path.normpath(root_abs))
        df = df.withColumn("rel_path", F.concat(F.lit(base + "/"), "rel_path"))
    return df


def scan_images(spark: SparkSession, root: str, max_images: int | None = None,
                use_dir_labels: bool = True) -> DataFrame:
    """S1 (+ S4, W2, P2): image files under ``root`` sorted by relative path.

    ``idx`` is the position in that order; labels come from ``dataset.json``
    (or its shards ``dataset-*.json``) in the root when it has any, else from
    top-level folder names.
    """
    files = list_files(spark, root).where(is_image_path("rel_path"))
    indexed = with_position(files, "rel_path", "idx")
    if max_images is not None:
        indexed = indexed.where(F.col("idx") < F.lit(int(max_images)))
    manifest = _manifest_if_any(spark, root)
    if manifest is not None:
        return indexed.join(manifest.withColumnRenamed("name", "rel_path"), "rel_path", "left")
    if use_dir_labels:
        return labels_from_top_dir(indexed, "rel_path")
    return indexed.withColumn("label", F.lit(None).cast("int"))


def manifest_files(spark: SparkSession, root: str) -> list[str]:
    """``dataset.json`` / ``dataset-*.json`` in ``root`` (any file system), sorted."""
    base = root.rstrip("/")
    if not path_exists(spark, base):
        return []
    # manifest files only: one per MANIFEST_ROWS images
    if local_path(base) is not None and os.path.isdir(local_path(base)):
        with os.scandir(local_path(base)) as entries:
            paths = ["file:" + os.path.abspath(e.path) for e in entries if re.fullmatch(r"dataset(-[^/]*)?\.json", e.name) and e.is_file()]
    else:
        paths = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "dataset*.json").load(base).select("path").collect()]
    return sorted(p for p in paths if re.fullmatch(r"dataset(-[^/]*)?\.json", p.rsplit("/", 1)[-1]))


def _manifest_if_any(spark: SparkSession, root: str):
    """Labels of the manifest in ``root``, or None when there is none or it holds no labels."""
    names = manifest_files(spark, root)
    if not names:
        return None
    manifest = read_label_manifest(spark, names)
    return None if manifest.limit(1).count() == 0 else manifest


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there; any other failure to look (permissions, I/O) is raised."""
    if local_path(path) is not None and os.path.isdir(local_path(path)):
        return True  # Spark would list all that is below it
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(0).collect()
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or str(e)):
            return False
        raise


# a store that only Spark reads ships a file as one value; Spark rejects values above 2 GB
MAX_SHIPPED_BYTES = (2 << 30) - (64 << 20)
#: bytes that a task reads of archives and stored arrays, at about
RANGE_BYTES = 64 << 20
#: small files that a task reads, at about
TASK_FILES = 1024


def _files_to_read(spark: SparkSession, raw: DataFrame, opener) -> DataFrame:
    """``path`` and, for a store that only Spark reads, ``content`` (refused above 2 GB)."""
    first = raw.select("path").first()
    if first is None or opener is not open_ranged or reachable(first["path"]):
        files = raw.select("path", F.lit(None).cast("binary").alias("content"))
    else:
        big = raw.where(F.col("length") > F.lit(MAX_SHIPPED_BYTES)).select("path", "length").limit(3).collect()
        if big:
            raise ValueError("too large to read as one value from a store that only Spark reads "
                             f"(give an opener, or split into files under 2 GB): {[(r['path'], r['length']) for r in big]}")
        files = raw.select("path", "content")
    return files.repartition(default_parallelism(spark))  # spread files over the task slots


def _opened(opener, path: str, content):
    return opener(path) if content is None else io.BytesIO(content)


_DIRECTORY = "archive string, member string, offset long, stored long, method int, crc long"


def archive_directory(spark: SparkSession, pattern: str, opener=open_ranged) -> DataFrame:
    """``archive, member, offset, stored, method, crc`` of the members of zip archives, from
    the directories at their ends; no member is read."""

    def read(batches):
        for rb in batches:
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                with _opened(opener, path, content) as fh:
                    found = zip_directory(fh)
                columns = [list(c) for c in zip(*found)] if found else [[]] * 5
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))],
                                                 names=["archive", *Member._fields])

    return _files_to_read(spark, spark.read.format("binaryFile").load(pattern), opener).mapInArrow(read, _DIRECTORY)


def read_archive_members(spark: SparkSession, members: DataFrame, opener=open_ranged) -> DataFrame:
    """``(archive, member, idx, label, content)`` of listed members.

    Members meet by ranges of (archive, offset), about ``RANGE_BYTES`` a task, and are
    read by their offsets, so a large archive is read by several tasks and none
    reads more than its members.  From a store that only Spark reads, the members
    of an archive meet its bytes in one row.
    """
    keep = [f for f in members.schema.fields if f.name in ("archive", "member", "idx", "label")]
    rows = members.select("archive", "offset", "stored", "method", "crc", "member", "idx", "label")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", content binary"
    first = members.select("archive").first()
    if first is not None and opener is open_ranged and not reachable(first["archive"]):
        inner = [c for c in rows.columns if c != "archive"]
        held = rows.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("members"))
        whole = spark.read.format("binaryFile").load([r[0] for r in held.select("archive").collect()])
        held = held.join(whole.select(F.col("path").alias("archive"), "content"), "archive")

        def unpack(batches):
            for rb in batches:
                for archive, found, content in zip(*(c.to_pylist() for c in rb.columns)):
                    yield from _member_batches(io.BytesIO(content), archive, found, keep)

        return held.select("archive", "members", "content").mapInArrow(unpack, schema)
    total = members.agg(F.coalesce(F.sum("stored"), F.lit(0))).first()[0]
    parts = max(default_parallelism(spark), -(-total // RANGE_BYTES))
    rows = rows.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches):
        for rb in batches:
            found = rb.to_pylist()
            for archive in dict.fromkeys(r["archive"] for r in found):
                with opener(archive) as fh:
                    yield from _member_batches(fh, archive, [r for r in found if r["archive"] == archive], keep)

    return rows.mapInArrow(read, schema)


def _member_batches(fh, archive: str, found: list[dict], keep):
    """The wanted columns and bytes of members of one archive, ``DEFAULT_ARRAY_BATCH`` at a time."""
    types = {"archive": pa.string(), "member": pa.string(), "idx": pa.int64()}
    for s in range(0, len(found), DEFAULT_ARRAY_BATCH):
        part = found[s:s + DEFAULT_ARRAY_BATCH]
        columns = {f.name: pa.array([archive if f.name == "archive" else r[f.name] for r in part], types.get(f.name) or to_arrow_type(f.dataType))
                   for f in keep}
        content = [read_member(fh, Member(*(r[c] for c in Member._fields))) for r in part]
        yield pa.RecordBatch.from_pydict(columns | {"content": pa.array(content, pa.binary())})


def _manifest_pairs(batches):
    """``archive, pos, member, text`` of the label pairs of ``dataset.json`` members, labels as JSON."""
    for rb in batches:
        for archive, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            data = json.loads(content).get("labels") or []
            yield pa.RecordBatch.from_arrays(
                [pa.array([archive] * len(data), pa.string()), pa.array(range(len(data)), pa.int64()), pa.array([str(x[0]) for x in data], pa.string()),
                 pa.array([None if x[1] is None else json.dumps(x[1]) for x in data], pa.string())], names=["archive", "pos", "member", "text"])


def scan_image_archives(spark: SparkSession, pattern: str, max_images: int | None = None, vectors: bool = False,
                        opener=open_ranged) -> DataFrame:
    """Image members of zip archives, ``(archive, member, idx, label, path)`` and where each lies,
    sorted by (archive, member); ``idx`` is the position.  Labels only from a
    ``dataset.json`` inside the archive (no folder fallback, as in the source), whole
    numbers or, with ``vectors``, arrays of numbers.  Only names are numbered and
    shuffled; :func:`read_archive_members` reads the bytes of what is still wanted.
    ``path`` is the archive."""
    entries = stage(archive_directory(spark, pattern, opener), "archive-directory")
    indexed = with_position(entries.where(is_image_path("member")), ["archive", "member"], "idx")
    if max_images is not None:
        indexed = indexed.where(F.col("idx") < F.lit(int(max_images)))
    documents = entries.where("member = 'dataset.json'").withColumn("idx", F.lit(0).cast("long")).withColumn("label", F.lit(None).cast("int"))
    pairs = read_archive_members(spark, documents, opener).select("archive", "content") \
        .mapInArrow(_manifest_pairs, "archive string, pos long, member string, text string")
    labels = pairs.withColumn("label", manifest_label(F.col("text"), vectors)).groupBy("archive", "member").agg(F.max_by("label", "pos").alias("label"))
    return indexed.join(labels, ["archive", "member"], "left").withColumn("path", F.col("archive"))


def unpack_archives(spark: SparkSession, members: DataFrame) -> tuple[DataFrame, str]:
    """Write the listed members as files ``<idx div 1000>/<idx>.<ext>`` under the shared
    checkpoint folder, for decoders that read files.  Returns ``(idx, path, label)`` and the folder."""
    from ..sinks.writers import local_root, write_file
    folder = f"{local_root(ensure_checkpoint_dir(spark)).rstrip('/')}/unpacked/{uuid.uuid4().hex}"
    if "://" in folder:
        folder = "/" + folder.split("://", 1)[1].lstrip("/")

    def write(batches):
        for rb in batches:
            paths = []
            for idx, member, content in zip(*(rb.column(c).to_pylist() for c in ("idx", "member", "content"))):
                paths.append(f"{folder}/{idx // 1000:05d}/{idx:08d}.{member.rsplit('.', 1)[-1]}")
                write_file(paths[-1], content)
            yield pa.RecordBatch.from_arrays([rb.column("idx"), pa.array(paths, pa.string()), rb.column("label")], names=["idx", "path", "label"])

    kind = members.schema["label"].dataType.simpleString()
    files = read_archive_members(spark, members)
    return stage(files.mapInArrow(write, f"idx long, path string, label {kind}"), "unpacked"), folder


def open_dataset(spark: SparkSession, source: str, max_images: int | None = None) -> DataFrame:
    """S3: a directory reads as an image folder; a ``.zip`` file (or a glob of
    them, e.g. ``shards/*.zip``) as archives."""
    local = local_path(source)
    if local is not None and os.path.isdir(local):
        return scan_images(spark, source, max_images)
    if source.rsplit(".", 1)[-1] == "zip":
        return scan_image_archives(spark, source, max_images)
    raise ValueError(f"unsupported or missing source: {source}")


# ---------------------------------------------------------------- arrays
def _read_npy(f) -> np.ndarray:
    shape, fortran, dtype = array_header(f)
    count = int(np.prod(shape)) if shape else 1
    data = np.frombuffer(f.read(count * dtype.itemsize), dtype=dtype, count=count)
    return data.reshape(shape, order="F" if fortran else "C")


def _ingest_npy(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            arr = _read_npy(io.BytesIO(content))
            rows.append((path, list(arr.shape), str(arr.dtype), arr.astype(np.float64).ravel()))
        yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "values"])


def _open_npy(batches):
    """As :func:`_ingest_npy`, for mounted files, which the task opens."""
    for rb in batches:
        for lo in range(0, rb.num_rows, DEFAULT_ARRAY_BATCH):
            paths, arrays = rb.column(0).slice(lo, DEFAULT_ARRAY_BATCH), []
            for path in paths.to_pylist():
                with open(path[len("file:"):], "rb") as fh:
                    arrays.append(_read_npy(fh))
            yield pa.RecordBatch.from_arrays(
                [paths, pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), pa.array([str(a.dtype) for a in arrays], pa.string()),
                 pa.array([a.astype(np.float64).ravel() for a in arrays], pa.list_(pa.float64()))], names=["path", "shape", "dtype", "values"])


def ingest_arrays(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """One ``.npy`` file per row: shape, dtype and row-major values (double)."""
    listed = listed_by_tasks(spark, pattern, recursive)
    if listed is not None:
        n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        tasks = max(4 * default_parallelism(spark), -(-n // TASK_FILES), -(-size // RANGE_BYTES))
        return listed.where(F.col("path").endswith(".npy")).select("path").repartition(tasks, "path").mapInArrow(_open_npy, ARRAY_SCHEMA)
    raw = load_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", recursive), pattern)
    raw = fewer_scan_tasks(raw.where(F.col("path").endswith(".npy")))
    return raw.select("path", "content").mapInPandas(_ingest_npy, ARRAY_SCHEMA)


def read_array_files(df: DataFrame, columns: dict[str, tuple[str, str]], opener=open_ranged) -> DataFrame:
    """``df`` with the ``.npy`` files that its path columns name: ``columns`` maps a path column to the
    names of its ``(values, shape)`` columns (row-major values as doubles).

    The task that holds a row opens its files, so only paths are ever exchanged.
    Paths must be in a store that ``opener`` can open.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    added = ", ".join(f"{v} array<double>, {s} array<int>" for v, s in columns.values())

    def read(batches):
        for rb in batches:
            for lo in range(0, rb.num_rows, DEFAULT_ARRAY_BATCH):
                part = rb.slice(lo, DEFAULT_ARRAY_BATCH)
                out = {n: part.column(n) for n in part.schema.names}
                for path, (values, shape) in columns.items():
                    arrays = []
                    for p in part.column(path).to_pylist():
                        with opener(p) as fh:
                            arrays.append(_read_npy(fh))
                    out[values] = pa.array([a.astype(np.float64).ravel() for a in arrays], pa.list_(pa.float64()))
                    out[shape] = pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(read, f"{fields}, {added}")


def ingest_array_batches(spark: SparkSession, pattern: str, member: str = "arr_0",
                         batch_size: int = DEFAULT_ARRAY_BATCH, opener=open_ranged) -> DataFrame:
    """Member ``member`` of each ``.npz`` holds N stacked arrays; one row per array.

    The rows of an uncompressed member are read in ranges of about ``RANGE_BYTES``,
    by several tasks for a large file; a compressed one is streamed by one task.
    Arrays are held ``batch_size`` at a time; a missing member is an error.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(pattern)
    name = member + ".npy"

    def heads(batches):
        for rb in batches:
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                with _opened(opener, path, content) as fh:
                    try:
                        a = stored_array(fh, name)
                    except KeyError:
                        raise KeyError(f"{path} has no member {member!r}") from None
                per = max(1, int(np.prod(a.shape)) * np.dtype(a.dtype).itemsize)
                step = a.rows if a.start is None or content is not None else max(1, RANGE_BYTES // per)
                lo = list(range(0, a.rows, max(1, step)))
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * len(lo), "lo": lo, "hi": [min(a.rows, x + step) for x in lo], "rows": [a.rows] * len(lo),
                     "inner": [a.shape] * len(lo), "dtype": [a.dtype] * len(lo), "start": [a.start] * len(lo), "content": [content] * len(lo)},
                    schema=pa.schema([("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("rows", pa.int64()), ("inner", pa.list_(pa.int64())),
                                      ("dtype", pa.string()), ("start", pa.int64()), ("content", pa.binary())]))

    def read(batches):
        for rb in batches:
            for path, lo, hi, rows, inner, dtype, start, content in zip(*(c.to_pylist() for c in rb.columns)):
                with _opened(opener, path, content) as fh:
                    for s, block in array_rows(fh, name, StoredArray(rows, inner, dtype, start), lo, hi, batch_size):
                        k = len(block)
                        values = np.ascontiguousarray(block, np.float64).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * k, pa.string()), pa.array([member] * k, pa.string()), pa.array(np.arange(s, s + k)),
                             pa.array([inner] * k, pa.list_(pa.int32())),
                             pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * block.shape[1], pa.int32()), pa.array(values))],
                            names=["path", "member", "row", "shape", "values"])

    ranges = _files_to_read(spark, raw, opener).mapInArrow(
        heads, "path string, lo long, hi long, rows long, inner array<long>, dtype string, start long, content binary")
    return ranges.repartition(default_parallelism(spark), "path", "lo").mapInArrow(read, BATCH_SCHEMA)


def scan_feature_set(spark: SparkSession, root: str, suffix: str = "_cls.npy",
                     sibling_suffix: str = "_patches.npy") -> DataFrame:
    """Files ending in ``suffix`` sorted by relative path, with the sibling path."""
    f = list_files(spark, root).where(F.col("rel_path").endswith(suffix))
    f = f.withColumn("sibling", F.regexp_replace("path", suffix.replace(".", r"\.") + "$", sibling_suffix))
    return with_position(f, "rel_path", "idx")


def load_npz_stats(spark: SparkSession, path: str, spatial: bool = False):
    """Precomputed statistics in the evaluator's ``.npz`` layout (keys ``mu``,
    ``sigma`` and, for spatial features, ``mu_s``, ``sigma_s``).  The file is
    fetched through Spark (any file system); its size is fixed by the feature
    width.  Returns None when the file or the keys are absent."""
    from ..operators.stats import FeatureStats
    if not path_exists(spark, path):
        return None
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        return None
    with np.load(io.BytesIO(row["content"])) as z:
        mk, sk = ("mu_s", "sigma_s") if spatial else ("mu", "sigma")
        if mk not in z.files or sk not in z.files:
            return None
        return FeatureStats(-1, np.asarray(z[mk], dtype=np.float64), np.asarray(z[sk], dtype=np.float64))


def load_or_compute_stats(features: DataFrame | None, stats_path: str | None = None,
                          feat_col: str = "features", spatial: bool = False):
    """Precomputed ``mu``/``sigma`` when present, else computed from the
    features (A3).  ``stats_path`` is an ``.npz`` in the evaluator's layout or
    a Parquet table with ``i``, ``n``, ``mu``, ``sigma_row`` (:func:`save_stats`)."""
    from ..operators.stats import FeatureStats, fit_statistics
    if stats_path and stats_path.endswith(".npz"):
        spark = features.sparkSession if features is not None else SparkSession.getActiveSession()
        st = load_npz_stats(spark, stats_path, spatial)
        if st is not None:
            return st
    elif stats_path:
        spark = (features.sparkSession if features is not None else SparkSession.getActiveSession())
        if path_exists(spark, stats_path):  # a missing table means compute
            t = spark.read.parquet(stats_path)
            rows = sorted(t.select("i", "n", "mu", "sigma_row").collect(), key=lambda r: r["i"])
            if rows:
                mu = np.array([r["mu"] for r in rows])
                sigma = np.vstack([np.asarray(r["sigma_row"]) for r in rows])
                return FeatureStats(int(rows[0]["n"]), mu, sigma)
    return fit_statistics(features, feat_col)


def save_stats(spark: SparkSession, stats, path: str) -> None:
    """Write ``FeatureStats`` as a D-row Parquet table (the input of S7)."""
    rows = [(i, int(stats.n), float(stats.mu[i]), [float(v) for v in stats.sigma[i]]) for i in range(len(stats.mu))]
    spark.createDataFrame(rows, "i int, n long, mu double, sigma_row array<double>").write.mode("overwrite").parquet(path)


__all__ = ["list_files", "scan_images", "scan_image_archives", "read_archive_members", "unpack_archives", "open_dataset", "ingest_arrays",
           "ingest_array_batches", "scan_feature_set", "load_or_compute_stats", "save_stats"]
