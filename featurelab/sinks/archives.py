"""O1 (zip destination): converted images as uncompressed zip archives, published on commit.

A Python data source writes them.  Every task fills archives of its own in a work
folder beside the destination, with the labels as ``dataset.json`` inside.  Only
when all tasks are done does the driver give the archives their names, in index
order; a failed job leaves nothing.  One archive of images is ``dest`` itself,
more are ``<dest without .zip>-00000.zip`` and so on: as (archive, name) order
is index order, scanning them gives the same images and labels again.
"""
from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
import warnings
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import default_parallelism, ensure_checkpoint_dir
from .writers import local_root, png_bytes

#: images of one archive at most
ARCHIVE_ROWS = 50_000
LISTING = "idx long, archive_path string, width int, height int, error string"
_MANIFEST = "dataset.json"


def archive_names(dest: str, n: int) -> list[str]:
    """The names of ``n`` archives of the destination ``dest``."""
    return [dest] if n <= 1 else [f"{dest[:-len('.zip')]}-{i:05d}.zip" for i in range(n)]


@dataclass
class _Written(WriterCommitMessage):
    """The archives of a task: name in the work folder, first index, whether every image has a label."""
    archives: list[tuple[str, int, bool]]


class _Archive:
    """One archive under construction, and the listing of what went into it."""

    def __init__(self, work: str, listing: str, first: int):
        self.name, self.first, self.labels, self.rows = uuid.uuid4().hex, first, [], 0
        self.zip = zipfile.ZipFile(f"{work}/{self.name}.zip", "w", zipfile.ZIP_STORED)
        self.listing = open(f"{listing}/{self.name}.json", "w")

    def add(self, row: dict) -> None:
        idx, image, error = row["idx"], row["image"], row["error"]
        done = {"idx": idx, "error": error or "missing or undecodable image"}
        if image is not None:
            s = f"{idx:08d}"
            done = {"idx": idx, "archive_path": f"{s[:5]}/img{s}.png", "width": image["width"], "height": image["height"]}
            self.zip.writestr(done["archive_path"], png_bytes(image["data"], image["width"], image["height"], image["nChannels"]))
            self.labels.append([done["archive_path"], json.loads(row["label"]).get("v")])
        self.listing.write(json.dumps(done) + "\n")
        self.rows += 1

    def close(self) -> tuple[str, int, bool]:
        labelled = all(v is not None for _, v in self.labels)
        self.zip.writestr(_MANIFEST, json.dumps({"labels": self.labels if labelled else None}))
        self.zip.close()
        self.listing.close()
        return self.name, self.first, labelled


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.dest, self.work, self.listing, self.limit = options["dest"], options["work"], options["listing"], int(options["rows"])

    def write(self, batches) -> _Written:
        done, current = [], None
        for rb in batches:
            for row in rb.to_pylist():
                if current is None or current.rows >= self.limit:
                    if current:
                        done.append(current.close())
                    current = _Archive(self.work, self.listing, row["idx"])
                current.add(row)
        if current:
            done.append(current.close())
        return _Written(done)

    def commit(self, messages) -> None:
        found = sorted((x for m in messages if m for x in m.archives), key=lambda x: x[1])
        names = {x[0] for x in found}
        for path in glob.glob(f"{self.listing}/*.json"):  # of attempts that were not the ones to succeed
            if os.path.basename(path)[:-len(".json")] not in names:
                os.remove(path)
        if not found:
            with zipfile.ZipFile(f"{self.work}/empty.zip", "w") as z:
                z.writestr(_MANIFEST, json.dumps({"labels": []}))
            found = [("empty", 0, True)]
        if any(x[2] for x in found) and not all(x[2] for x in found):  # P8: one image without a label unlabels all
            for name, _, labelled in found:
                if labelled:
                    with warnings.catch_warnings(), zipfile.ZipFile(f"{self.work}/{name}.zip", "a", zipfile.ZIP_STORED) as z:
                        warnings.simplefilter("ignore", UserWarning)  # a later member of the same name counts
                        z.writestr(_MANIFEST, json.dumps({"labels": None}))
        for (name, _, _), path in zip(found, archive_names(self.dest, len(found))):
            os.replace(f"{self.work}/{name}.zip", path)
        shutil.rmtree(self.work)

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)
        shutil.rmtree(self.listing, ignore_errors=True)


class ImageArchives(DataSource):
    """``idx, image, error, label`` rows as archives."""

    @classmethod
    def name(cls) -> str:
        return "image_archives"

    def schema(self) -> str:
        return LISTING

    def writer(self, schema, overwrite: bool) -> _ArchiveWriter:
        return _ArchiveWriter({k: self.options[k] for k in ("dest", "work", "listing", "rows")})


def write_image_archives(df: DataFrame, dest: str, label_col: str = "label", rows_per_archive: int = ARCHIVE_ROWS) -> DataFrame:
    """Write ``idx, image, error, label`` rows as archives ``dest`` (``*.zip``) and return the listing of
    what was written, ``(idx, archive_path, width, height, error)``; rows without an image (P3) have a null path.
    Needs the destination's folder mounted on the executors (POSIX path)."""
    spark = df.sparkSession
    root = local_root(dest)
    if glob.glob(root) or glob.glob(f"{glob.escape(root[:-len('.zip')])}-[0-9]*.zip"):
        raise ValueError(f"destination exists: {dest}")
    work = f"{root}.{uuid.uuid4().hex}.work"
    listing = f"{local_root(ensure_checkpoint_dir(spark)).rstrip('/')}/listings/{uuid.uuid4().hex}"
    for folder in (work, listing):
        os.makedirs(folder)
    spark.dataSource.register(ImageArchives)
    rows = df.select(F.col("idx").cast("bigint").alias("idx"), "image", "error", F.to_json(F.struct(F.col(label_col).alias("v"))).alias("label"))
    rows = rows.repartitionByRange(default_parallelism(spark), "idx").sortWithinPartitions("idx")
    try:
        rows.write.format("image_archives").mode("append").options(dest=root, work=work, listing=listing, rows=rows_per_archive).save()
    except Exception:  # a stage before the writer failed: there is no abort
        for folder in (work, listing):
            shutil.rmtree(folder, ignore_errors=True)
        raise
    return spark.read.schema(LISTING).json(listing)
