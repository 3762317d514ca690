"""Session defaults and shared-storage helpers."""
from __future__ import annotations

import contextlib
import hashlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", app: str = "featurelab",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """SparkSession tuned for the operators in this package.

    AQE stays on (coalescing and skew-join splitting at runtime), Arrow is on
    for the pandas blocks, and the UI is off (no server is started).
    """
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         # staged positions / scans / radii are reliable checkpoints: drop them once unreferenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("FEATURELAB_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names shared storage and is only read here.  In
    local mode, where driver and tasks share one disk, a fresh scratch folder is
    created and set when it is unset; any other master without it is an error.
    """
    sc = _context(spark)
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur and sc is not None:
        cur = sc.getConf().get("spark.checkpoint.dir", None)
    if not cur:
        if sc is None or not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        cur = tempfile.mkdtemp(prefix="featurelab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if sc is not None:
        sc.setCheckpointDir(cur)
    return cur


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staged(df: DataFrame, name: str):
    """As :func:`stage`, for tables that are done with when the block ends: they are deleted then."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows (kept under Spark Connect, which has no handle on it)."""
    sc = _context(spark)
    if sc is not None:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def default_parallelism(spark: SparkSession) -> int:
    """Total task slots of the cluster (cores), used to size partial aggregates."""
    sc = _context(spark)
    if sc is not None:
        return max(1, int(sc.defaultParallelism))
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


#: scan partitions of a folder of small files (about 32 files each) that one task reads
SCANS_PER_TASK = 32


def fewer_scan_tasks(df: DataFrame) -> DataFrame:
    """A scan of many small files by fewer tasks.

    Spark's scan has a partition for about every 32 small files (or 128 MB), and the driver and the Python
    workers spend more on such a task than on its files.  Partitions are put together, without an exchange,
    down to four tasks per slot; no task takes more than ``SCANS_PER_TASK`` of them beyond that.
    """
    if _context(df.sparkSession) is None:
        return df
    few = max(4 * default_parallelism(df.sparkSession), -(-df.rdd.getNumPartitions() // SCANS_PER_TASK))
    return df.coalesce(few)


def load_files(reader, paths) -> DataFrame:
    """``reader.load(paths)``, where a pattern of file names (``folder/*/*.png``) is a filter on the
    listing of its folders; Spark would take every file it matches as a folder to list.
    ``reader`` yields whole files with their path in ``path`` or ``image.origin``."""
    folder, _, name = paths.rpartition("/") if isinstance(paths, str) else ("", "", "")
    if not folder.strip("/") or "{" in paths or not re.search(r"[*?\[]", name):
        return reader.load(paths)
    found = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    origin = "path" if "path" in found.columns else "image.origin"
    bare = lambda p: re.sub(r"^file:/*", "/", p)
    depth = len(bare(paths if "://" in paths or paths.startswith("file:") else os.path.abspath(paths)).split("/"))
    return found.where(F.size(F.split(F.regexp_replace(F.col(origin), "^file:/*", "/"), "/")) == depth)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``featurelab`` importable in every Python worker (``addPyFile``).

    Task closures refer to package functions by module name, so executors
    need the package; the zip is written once per content hash under the
    shared checkpoint folder and registered with the context.
    """
    sc = _context(spark)
    key = (id(sc), sc.applicationId) if sc is not None else ("connect", id(spark))
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(r, f) for r, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    h = hashlib.sha1()
    for f in files:
        h.update(f[len(pkg):].encode())
        with open(f, "rb") as fh:
            h.update(fh.read())
    root = ensure_checkpoint_dir(spark)
    root = root[len("file:"):] if root.startswith("file:") else root
    if "://" in root:  # non-POSIX shared storage: stage the zip in a driver scratch folder
        root = tempfile.mkdtemp(prefix="featurelab-py-")
    os.makedirs(os.path.join(root, "pyfiles"), exist_ok=True)
    path = os.path.join(root, "pyfiles", f"featurelab-{h.hexdigest()[:12]}.zip")
    if not os.path.exists(path):
        tmp = path + f".{os.getpid()}.tmp"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.join("featurelab", os.path.relpath(f, pkg)))
        os.replace(tmp, path)
    if sc is not None:
        sc.addPyFile(path)
    else:  # Spark Connect: ship as a session artifact
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)
