"""Session and staging helpers shared by the training-data operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package, stage

__all__ = ["partitions", "prepare", "stage", "table"]


#: rows of an Arrow batch: texts of some kB each, so that a worker holds tens of MB at a time
BATCH_ROWS = 2048


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the workers, and Arrow batches of at most ``BATCH_ROWS`` rows."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
