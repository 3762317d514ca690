"""Deterministic random draws keyed by (seed, row key, ...).

Torch random streams cannot be reproduced in Spark; the contract kept is the
distribution plus determinism given the seed and the row key, independent of
partitioning and of task retries (``rand()`` is never used).

A uniform is the first 32 bits of ``md5("seed:key1:key2...")`` divided by
2^32, which DuckDB reproduces exactly as
``('0x' || substr(md5(k), 1, 8))::BIGINT / 4294967296.0``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
# Offset added before the logarithm in Box-Muller so that ln(0) never occurs.
LOG_GUARD = 2.0 ** -33


def _key(seed, *keys) -> Column:
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    for k in keys:
        parts.append(k.cast("string") if isinstance(k, Column) else F.lit(str(k)))
    return F.concat_ws(":", *parts)


def uniform(seed, *keys) -> Column:
    """U[0, 1) draw for the given seed and keys."""
    h = F.substring(F.md5(_key(seed, *keys)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(TWO_32)


def normal(seed, *keys) -> Column:
    """N(0, 1) draw by Box-Muller from two keyed uniforms (tags ``u`` and ``v``)."""
    u1 = uniform(seed, *keys, "u")
    u2 = uniform(seed, *keys, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u1 + F.lit(LOG_GUARD))) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal_vector(seed, key: Column, dim) -> Column:
    """array<double> of ``dim`` i.i.d. normals, element i keyed by (seed, key, i)."""
    n = dim if isinstance(dim, Column) else F.lit(int(dim))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: normal(seed, key, i))


def uniform_sql(seed, key_sql: str) -> str:
    """DuckDB / Spark-SQL text of :func:`uniform` (used by oracle queries)."""
    return (f"(('0x' || substr(md5('{seed}' || ':' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"
            f" / 4294967296.0::DOUBLE)")
