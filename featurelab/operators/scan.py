"""Ordered linear recurrences (running totals, EMA, carry-forward) without one-task windows.

``state_t = a_t * state_{t-1} + b_t * x_t`` per key in sequence order; the first
row of a key copies its value (``state_0 = x_0``).  ``a``/``b`` are constants or
per-row columns: ``a = b = 1`` is a running total, ``a = d, b = 1 - d`` an
exponential moving average, ``a = 1 - live, b = live`` a carry-forward of the
last live value.  Several value columns can share one pass.

A window ``PARTITION BY key ORDER BY seq`` holds one key in one task, which
fails when a key carries a third of the rows.  Here rows are range
partitioned on ``(key, seq)`` (a hot key spans many partitions), written once
to the checkpoint folder so both passes see identical partitions, and:

1. each partition reports at most two edge-segment summaries (its first and
   last key run): the segment's state as an affine function of the incoming
   carry, ``end = A * carry + B``, plus its value when the key starts there;
2. the driver scans those summaries (bounded by the partition count, never
   by the data) and derives the carry entering each partition;
3. each partition replays its rows with the carry in Arrow batches.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_parallelism, ensure_checkpoint_dir

_PID = "_fl_pid"
_A, _B = "_fl_a", "_fl_b"
# Rows per closed-form chunk when coefficients vary per row (keeps products representable).
VAR_CHUNK = 64


def _recur_const(x: np.ndarray, a: float, b: float, s0: float | None) -> np.ndarray:
    n = len(x)
    out = np.empty(n)
    if n == 0:
        return out
    out[0] = x[0] if s0 is None else a * s0 + b * x[0]
    if a == 1.0:
        out[1:] = out[0] + b * np.cumsum(x[1:])
        return out
    if a == 0.0:
        out[1:] = b * x[1:]
        return out
    # closed form in chunks short enough that a^-L stays representable
    L = max(1, min(4096, int(200.0 / max(1e-12, abs(math.log(abs(a)))))))
    prev, i = out[0], 1
    while i < n:
        j = min(n, i + L)
        pw = np.power(a, np.arange(1, j - i + 1, dtype=np.float64))
        out[i:j] = pw * (prev + np.cumsum(b * x[i:j] / pw))
        prev, i = out[j - 1], j
    return out


def _recur_var(x: np.ndarray, a: np.ndarray, b: np.ndarray, s0: float | None) -> np.ndarray:
    n = len(x)
    out = np.empty(n)
    if n == 0:
        return out
    bx = b * x
    # a = 0 resets the state, whatever came before (an inf or NaN carry included)
    out[0] = x[0] if s0 is None else bx[0] if a[0] == 0 else a[0] * s0 + bx[0]
    prev, i = out[0], 1
    while i < n:
        j = min(n, i + VAR_CHUNK)
        aa = a[i:j]
        start = 0
        for z in list(np.flatnonzero(aa == 0)) + [j - i]:
            while start < z:  # run of non-zero coefficients: closed form by cumulative products
                size = np.abs(np.cumsum(np.log(np.abs(aa[start:z]))))
                far = np.flatnonzero(size > 200.0)  # cut before the product leaves the range of doubles
                e = z if not len(far) else start + max(1, int(far[0]))
                p = np.cumprod(aa[start:e])
                out[i + start:i + e] = p * (prev + np.cumsum(bx[i + start:i + e] / p))
                prev = out[i + e - 1]
                start = e
            if z < j - i:  # a = 0 resets the state
                out[i + z] = bx[i + z]
                prev = out[i + z]
            start = z + 1
        i = j
    return out


def _recur(x, a, b, s0):
    if np.isscalar(a) and np.isscalar(b):
        return _recur_const(x, float(a), float(b), s0)
    a = np.broadcast_to(a, x.shape).astype(np.float64)
    b = np.broadcast_to(b, x.shape).astype(np.float64)
    return _recur_var(x, a, b, s0)


def _segments(pdf: pd.DataFrame, keys: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, key repr) of runs of equal consecutive keys, found vectorised."""
    n = len(pdf)
    if n == 0:
        return []
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        col = pdf[k]
        prev = col.shift(1)
        diff = (col != prev).to_numpy()
        both_null = (col.isna() & prev.isna()).to_numpy()
        change |= diff & ~both_null
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    cols = [pdf[k].to_numpy() for k in keys]
    return [(int(a), int(b), repr(tuple(c[a].item() if hasattr(c[a], "item") else c[a] for c in cols)))
            for a, b in zip(starts, ends)]


class _Edge:
    """Running summary of one key run: ``end = A * carry + B``; ``S`` = end if the key starts here.

    Only a partition's first run can continue a key from the previous
    partition, so only it tracks ``A`` and ``B`` (``need_carry``).
    """

    def __init__(self, key, nv, need_carry: bool = True):
        self.key, self.A, self.B, self.S = key, 1.0, np.zeros(nv), None
        self.need_carry = need_carry

    def extend(self, xs, a, b, fresh: bool):
        if self.need_carry:
            prod_a = float(np.prod(a)) if not np.isscalar(a) else float(a) ** len(xs[0])
            self.B = np.array([_recur(x, a, b, float(s))[-1] for x, s in zip(xs, self.B)])
            self.A *= prod_a
        if fresh:
            self.S = np.array([_recur(x, a, b, None)[-1] for x in xs])
        elif self.S is not None:
            self.S = np.array([_recur(x, a, b, float(s))[-1] for x, s in zip(xs, self.S)])


def linear_scan(df: DataFrame, key_cols: list[str], order_cols: list[str], value_cols,
                a, b, out_cols, num_partitions: int | None = None) -> DataFrame:
    """Append the recurrence state of each value column (see module doc).

    ``a``/``b`` are floats or names of numeric columns; ``value_cols`` and
    ``out_cols`` are a name or equal-length lists.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    outs = [out_cols] if isinstance(out_cols, str) else list(out_cols)
    n = num_partitions or max(default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = list(key_cols)
    if not keys:
        df = df.withColumn("_fl_k", F.lit(0))
        keys = ["_fl_k"]
    var = not (isinstance(a, (int, float)) and isinstance(b, (int, float)))
    if var:
        df = df.withColumn(_A, (F.col(a) if isinstance(a, str) else F.lit(float(a))).cast("double")) \
               .withColumn(_B, (F.col(b) if isinstance(b, str) else F.lit(float(b))).cast("double"))
    order = keys + list(order_cols)
    staged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn(_PID, F.spark_partition_id()))
    staged = staged.checkpoint(eager=True)

    def coef(pdf, s, e):
        if not var:
            return float(a), float(b)
        return pdf[_A].to_numpy(np.float64)[s:e], pdf[_B].to_numpy(np.float64)[s:e]

    def summarize(batches):
        # streams Arrow batches, keeping only the running state of the edge segments
        pid, first, last, n_segs = None, None, None, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if pid is None:
                pid = int(pdf[_PID].iloc[0])
            xs = [pdf[v].to_numpy(np.float64) for v in vals]
            for s, e, k in _segments(pdf, keys):
                ca, cb = coef(pdf, s, e)
                seg = [x[s:e] for x in xs]
                if last is not None and k == last.key:
                    last.extend(seg, ca, cb, fresh=False)
                    continue
                n_segs += 1
                last = _Edge(k, len(vals), need_carry=first is None)
                last.extend(seg, ca, cb, fresh=True)
                if first is None:
                    first = last
        if pid is None:
            return
        rows = [{"pid": pid, "which": "first", "key": first.key, "A": first.A,
                 "B": list(first.B), "S": list(first.S)}]
        if n_segs > 1:
            rows.append({"pid": pid, "which": "last", "key": last.key, "A": last.A,
                         "B": list(last.B), "S": list(last.S)})
        yield pd.DataFrame(rows)

    summaries = staged.mapInPandas(
        summarize, "pid int, which string, key string, A double, B array<double>, S array<double>").collect()
    by_pid: dict[int, dict] = {}
    for r in summaries:  # at most two rows per partition
        by_pid.setdefault(r["pid"], {})[r["which"]] = r
    carry: dict[int, list | None] = {}
    prev_key, prev_state = None, None
    for pid in sorted(by_pid):
        f = by_pid[pid]["first"]
        if f["key"] == prev_key:
            carry[pid] = prev_state
            end_first = [f["A"] * c + bb for c, bb in zip(prev_state, f["B"])]
        else:
            carry[pid] = None
            end_first = list(f["S"])
        if "last" in by_pid[pid]:
            prev_key, prev_state = by_pid[pid]["last"]["key"], list(by_pid[pid]["last"]["S"])
        else:
            prev_key, prev_state = f["key"], end_first

    out_schema = T.StructType(list(staged.schema.fields) + [T.StructField(o, T.DoubleType()) for o in outs])

    def replay(batches):
        state, key, started = None, None, False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            xs = [pdf[v].to_numpy(np.float64) for v in vals]
            res = [np.empty(len(pdf)) for _ in vals]
            for s, e, k in _segments(pdf, keys):
                if not started:
                    s0 = carry.get(int(pdf[_PID].iloc[0]))
                    started = True
                elif k == key:
                    s0 = state
                else:
                    s0 = None
                ca, cb = coef(pdf, s, e)
                new_state = []
                for j, x in enumerate(xs):
                    seg = _recur(x[s:e], ca, cb, None if s0 is None else float(s0[j]))
                    res[j][s:e] = seg
                    new_state.append(float(seg[-1]))
                state, key = new_state, k
            yield pdf.assign(**{o: r for o, r in zip(outs, res)})

    result = staged.mapInPandas(replay, out_schema).drop(_PID)
    if var:
        result = result.drop(_A, _B)
    if not key_cols:
        result = result.drop("_fl_k")
    return result


def running_total(df: DataFrame, key_cols: list[str], order_cols: list[str], value_col,
                  out_col, exclusive: bool = False) -> DataFrame:
    """Running sum per key in order; ``exclusive`` leaves out the row itself."""
    r = linear_scan(df, key_cols, order_cols, value_col, 1.0, 1.0, out_col)
    if exclusive:
        vals = [value_col] if isinstance(value_col, str) else value_col
        outs = [out_col] if isinstance(out_col, str) else out_col
        for v, o in zip(vals, outs):
            r = r.withColumn(o, F.col(o) - F.col(v).cast("double"))
    return r


def ema(df: DataFrame, key_cols: list[str], order_cols: list[str], value_col: str,
        decay: float = 0.9999, out_col: str = "ema") -> DataFrame:
    """``e = d * e + (1 - d) * x``, the first value of a key initialising ``e``."""
    return linear_scan(df, key_cols, order_cols, value_col, float(decay), 1.0 - float(decay), out_col)


def carry_forward(df: DataFrame, key_cols: list[str], order_cols: list[str], value_cols,
                  live_col: str, out_cols) -> DataFrame:
    """Per key, the value of the last row where ``live_col`` holds (0 before any)."""
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    live = F.col(live_col).cast("boolean")
    staged = df
    for v in vals:
        staged = staged.withColumn(f"_fl_x_{v}", F.when(live, F.col(v).cast("double")).otherwise(F.lit(0.0)))
    staged = (staged.withColumn("_fl_on", F.when(live, F.lit(1.0)).otherwise(F.lit(0.0)))
              .withColumn("_fl_keep", F.when(live, F.lit(0.0)).otherwise(F.lit(1.0))))
    r = linear_scan(staged, key_cols, order_cols, [f"_fl_x_{v}" for v in vals], "_fl_keep", "_fl_on", out_cols)
    return r.drop("_fl_on", "_fl_keep", *[f"_fl_x_{v}" for v in vals])
