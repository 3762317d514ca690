"""Global positions in sorted order without a single-partition window.

``row_number() OVER (ORDER BY k)`` moves every row into one task.  Here

1. a sample of the order keys (those of the smallest hashes: of bounded size,
   mergeable, and the same whatever the partitioning) gives splitters, which
   become literals of the plan;
2. one aggregate over the key columns counts the rows between two splitters;
3. the rows meet by bucket, are numbered inside it, and the rows of the buckets
   before it are added, again a literal.

Nothing is written: the rows pass one exchange.  Splitters and counts are fixed
values, so a recomputed partition (lost executor) gives the same positions, and
positions do not depend on the number of partitions.  What the driver holds is
bounded by ``MAX_BUCKETS``, never by the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism

#: buckets per shuffle partition (hashed to tasks, several smooth their sizes), and at most
BUCKETS_PER_PARTITION, MAX_BUCKETS = 2, 16_384
#: sampled keys per bucket: a bucket's size varies by about a fifth
SAMPLED = 32

_BUCKET = "_fl_bucket"


def _as_cols(order) -> list[Column]:
    if isinstance(order, (str, Column)):
        order = [order]
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _key(cols: list[Column]) -> Column:
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(cols)))


def key_splitters(df: DataFrame, order, buckets: int, sampled: int = SAMPLED) -> Column | None:
    """Literal array of the splitters of ``buckets`` parts of about equal size; None if the sample is empty."""
    key = df.select(_key(_as_cols(order)).alias("k"))
    h = F.xxhash64("k")
    # the limit leaves one partition of bounded size: it is sorted where it is (a key twice among the splitters does no harm)
    sample = key.orderBy(h).limit(buckets * sampled).coalesce(1).sortWithinPartitions("k").select("k.*")
    rows = sample.collect()
    if not rows:
        return None
    at = sorted({len(rows) * i // buckets for i in range(1, buckets)} - {0})
    types = [(f.name, f.dataType) for f in sample.schema.fields]
    value = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return F.array(*(F.struct(*(F.lit(value(r[n])).cast(t).alias(n) for n, t in types)) for r in (rows[i] for i in at)))


def bucket_of(order, splitters: Column | None, buckets: int) -> Column:
    """Number of splitters at or below the key, by binary search."""
    if splitters is None or buckets < 2:
        return F.lit(0)
    key = _key(_as_cols(order))
    steps = [1 << j for j in range(buckets.bit_length() - 1, -1, -1)]
    # beyond the last splitter there is null, which is not at or below the key
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, step: F.when(key >= F.get(splitters, at + step - 1), at + step).otherwise(at))


def with_position(df: DataFrame, order, name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based ``name`` column following ``order`` (ascending, nulls first).

    ``order`` should be a unique key (add a tiebreaker otherwise) so that a
    recomputed partition (lost executor) yields the same positions.
    """
    cols = _as_cols(order)
    n = num_partitions or max(default_parallelism(df.sparkSession),
                              int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(BUCKETS_PER_PARTITION * n, MAX_BUCKETS)
    bucket = bucket_of(cols, key_splitters(df, cols, buckets), buckets)
    counts = {r[0]: r[1] for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1))).collect()}
    before, total = [], 0
    for b in range(buckets):
        before.append(total)
        total += counts.get(b, 0)
    inside = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*cols)) - 1
    offset = F.get(F.array(*(F.lit(x).cast("bigint") for x in before)), F.col(_BUCKET))
    return df.withColumn(_BUCKET, bucket).withColumn(name, (offset + inside).cast("bigint")).drop(_BUCKET)


def chunk_id(pos: Column | str, size: int) -> Column:
    """Chunk number of a 0-based position (``pos div size``)."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(int(size))).cast("bigint")


def order_results(df: DataFrame, key: str, num_partitions: int | None = None) -> DataFrame:
    """K3: output in ``key`` order regardless of which task finishes first.

    Range partitioning plus a local sort: file part i holds the i-th key range,
    so writing the frame yields globally ordered files with no single task.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.col(key)).sortWithinPartitions(key)
