"""T4, T5: keyed permutations of ``0..n-1`` as column arithmetic.

A position is split over two factors ``a * b >= n`` close to the square root of
``n`` and goes through ``ROUNDS`` Feistel rounds, each of which adds a keyed value of
one half to the other half; values from ``n`` on are sent through again
(cycle walking).  So any place of a shuffled epoch is computed on its own, in both
directions, without sorting ``n`` rows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import _key

ROUNDS = 8
#: fixed value: modulus of the round function, 2**31 - 1, so that products fit a long
MODULUS = 2147483647
#: times a value may be sent through again.  Fewer than ``a`` values lie from ``n`` on: up to
#: n = 1024 that many steps always suffice, beyond it each misses with probability below 1/32
WALK = 33


def factors(n: int) -> tuple[int, int]:
    """Two factors whose product is ``n`` or a little more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _parts(seed, keys) -> list[Column]:
    h = F.md5(_key(seed, *keys))
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") % MODULUS for i in range(4)]


def _value(v: Column, j: Column, p: list[Column]) -> Column:
    t = (v + p[0] + j * p[1]) % MODULUS
    return (t * t) % MODULUS * (1 + (p[2] + j * p[3]) % (MODULUS - 1)) % MODULUS


def _once(x: Column, a: int, b: int, p: list[Column], back: bool) -> Column:
    """All rounds, or all of them undone."""
    sign = -1 if back else 1
    js = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def turn(s, j):
        low = F.when(j % 2 == 0, F.pmod(s["low"] + sign * (_value(s["high"], j, p) % a), F.lit(a))).otherwise(s["low"])
        high = F.when(j % 2 == 1, F.pmod(s["high"] + sign * (_value(s["low"], j, p) % b), F.lit(b))).otherwise(s["high"])
        return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    start = F.struct((x % a).cast("bigint").alias("low"), F.floor(x / a).cast("bigint").alias("high"))
    return F.aggregate(F.array(*(F.lit(j).cast("bigint") for j in js)), start, turn, lambda s: s["high"] * a + s["low"])


def _permute(x, n: int, seed, keys, back: bool) -> Column:
    a, b = factors(n)
    p = _parts(seed, keys)
    x = (F.col(x) if isinstance(x, str) else x).cast("bigint")
    again = lambda v, _: F.when(v < n, v).otherwise(_once(v, a, b, p, back))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _once(x, a, b, p, back), again)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a keyed permutation left its range")).cast("bigint"))


def permuted(x, n: int, seed, *keys) -> Column:
    """Where the keyed permutation of ``0..n-1`` sends ``x``."""
    return _permute(x, n, seed, keys, False)


def unpermuted(x, n: int, seed, *keys) -> Column:
    """Which value the keyed permutation of ``0..n-1`` sends to ``x``."""
    return _permute(x, n, seed, keys, True)


def permuted_sql(rows: str, seed: str) -> str:
    """DuckDB CTEs (for ``WITH RECURSIVE``) that end in ``permuted(j, epoch, x)``: the images of ``rows(j, epoch, q)`` under
    the permutation of ``0..n-1`` keyed by ``seed`` and the epoch, with ``n`` from a CTE ``n(n)``."""
    part = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT % {MODULUS}"
    value = lambda v, j: (f"((({v} + k0 + {j} * k1) % {MODULUS}) * (({v} + k0 + {j} * k1) % {MODULUS})) % {MODULUS}"  # noqa: E731
                          f" * (1 + (k2 + {j} * k3) % {MODULUS - 1}) % {MODULUS}")
    inner = "SELECT j, epoch, step, a, b, n, k0, k1, k2, k3, x % a AS low, x // a AS high FROM walk WHERE step = 0 OR x >= n"
    for j in range(ROUNDS):
        half = f"(low + {value('high', j)} % a) % a AS low" if j % 2 == 0 else f"(high + {value('low', j)} % b) % b AS high"
        inner = f"SELECT * REPLACE ({half}) FROM ({inner})"
    return f"""
ab AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM n)),
start AS (SELECT j, epoch, q AS x, n, a, b, md5('{seed}' || ':' || epoch::VARCHAR) AS h FROM ({rows}) r, ab),
walk(j, epoch, step, a, b, n, k0, k1, k2, k3, x) AS (
  SELECT j, epoch, 0, a, b, n, {part(0)}, {part(1)}, {part(2)}, {part(3)}, x FROM start
  UNION ALL
  SELECT j, epoch, step + 1, a, b, n, k0, k1, k2, k3, high * a + low FROM ({inner})),
permuted AS (SELECT j, epoch, x FROM walk WHERE step > 0 AND x < n)"""
