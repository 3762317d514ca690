"""Listings of mounted folders by tasks, for folders of more files than the driver may hold.

A scan by Spark's file sources keeps some kB a file on the driver for as long as its DataFrame is there.
Folders of more than ``DRIVER_FILES`` files are listed by tasks instead, and what only a file source can
read (images) is read in groups of so many files, one after the other.
"""
from __future__ import annotations

import contextlib
import gc
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import default_parallelism, stage
from .ranged import local_path

#: files that the driver lists at a time, at most
DRIVER_FILES = 25_000
#: listed files a batch
LISTED_ROWS = 10_000


def visible(name: str) -> bool:
    """Whether Spark's file index lists the name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def walked(spark: SparkSession, folders: list[tuple[str, bool]]) -> DataFrame:
    """``path, length`` of the files in mounted folders and, where the flag says so, in all folders below; listed by tasks."""

    def read(batches):
        for rb in batches:
            for folder, below in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                todo = [folder]
                while todo:
                    paths, sizes = [], []
                    with os.scandir(todo.pop()) as entries:
                        for e in entries:
                            if not visible(e.name):
                                continue
                            if not e.is_dir():
                                paths.append("file:" + e.path)
                                sizes.append(e.stat().st_size)
                            elif below:
                                todo.append(e.path)
                    for lo in range(0, len(paths), LISTED_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(paths[lo:lo + LISTED_ROWS], pa.string()), pa.array(sizes[lo:lo + LISTED_ROWS], pa.int64())],
                                                         names=["path", "length"])

    tasks = max(1, min(len(folders), 4 * default_parallelism(spark)))
    return spark.createDataFrame(folders, "folder string, below boolean").repartition(tasks).mapInArrow(read, "path string, length long")


def subfolders(root: str) -> list[tuple[str, bool]]:
    """The folders of ``root`` for :func:`walked`: its own files are listed by one task, each folder in it by another."""
    with os.scandir(root) as entries:
        return [(root, False)] + [(e.path, True) for e in entries if visible(e.name) and e.is_dir()]


def _wildcards(pattern: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern)


def _matched(folder: str) -> list[str]:
    """The folders that a pattern names, hidden ones too (as Spark takes them)."""
    found = ["/"]
    for part in folder.strip("/").split("/"):
        if not re.search(r"[*?]", part):
            found = [x for x in (os.path.join(f, part) for f in found) if os.path.isdir(x)]
            continue
        below = []
        for f in found:
            with os.scandir(f) as entries:
                below += [e.path for e in entries if re.fullmatch(_wildcards(part), e.name, re.DOTALL) and e.is_dir()]
        found = below
    return found


def _more_than(folders: list[tuple[str, bool]], limit: int) -> bool:
    n, todo = 0, list(folders)
    while todo:
        folder, below = todo.pop()
        with os.scandir(folder) as entries:
            for e in entries:
                if visible(e.name):
                    n += 1
                    if n > limit:
                        return True
                    if below and e.is_dir():
                        todo.append((e.path, True))
    return False


def listed_by_tasks(spark: SparkSession, paths, recursive: bool) -> DataFrame | None:
    """``path, length`` of a mounted folder and all below (``recursive``), or of a pattern of file names (``folder/*/*.png``),
    if these are more files than the driver may list; else None.  Empty files are left out, as Spark's scans do."""
    if not isinstance(paths, str) or local_path(paths) is None or re.search(r"[{}\[\]\\]", paths):
        return None
    root = os.path.abspath(paths[len("file:"):] if paths.startswith("file:") else paths)
    folder, name = os.path.split(root)
    if re.search(r"[*?]", name):
        folders = [(f, False) for f in _matched(folder)]
    elif recursive and os.path.isdir(root) and not re.search(r"[*?]", folder):
        folders, name = [(root, True)], None
    else:
        return None
    if not _more_than(folders, DRIVER_FILES):
        return None
    found = walked(spark, subfolders(root) if name is None else folders).where("length > 0")
    if name is not None:
        found = found.where(F.element_at(F.split("path", "/"), -1).rlike(f"^(?s:{_wildcards(name)})$"))
    return stage(found, "files")


@contextlib.contextmanager
def _listing_of_files(spark: SparkSession):
    """Settings to load files by their names: as few listing tasks as there are slots for, and no listing is kept for later."""
    confs = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * default_parallelism(spark)),
             "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def load_groups(spark: SparkSession, make_reader, listed: DataFrame, read) -> DataFrame:
    """``read`` of a file source's rows for all files of ``listed``, about ``DRIVER_FILES`` of them at a time.

    ``make_reader()`` gives a reader of whole files; ``read`` takes the rows of a group to what is kept (staged)
    of it, so decode and shrink there.  The driver holds one group's listing."""
    groups = -(-listed.count() // DRIVER_FILES)
    out = None
    for g in range(groups):
        names = listed.where(F.pmod(F.xxhash64("path"), F.lit(groups)) == g).select("path").toArrow().column(0).to_pylist()
        if not names:
            continue
        with _listing_of_files(spark):
            # a name is no pattern
            raw = make_reader().option("recursiveFileLookup", "true").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", n) for n in names])
        part = stage(read(raw), "group")
        out = part if out is None else out.unionByName(part)
        del raw, names
        gc.collect()  # handles lie in cycles: until they are collected, the JVM keeps the group's listing
    return out
