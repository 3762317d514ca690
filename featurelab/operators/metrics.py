"""Training metric collection as aggregates.

Moments are ``(num, sum, sumsq)`` per name: constant-size, mergeable partial
aggregates, so a hot name is combined map-side before any shuffle.  Ordered
forms (sync groups, EMA) pre-aggregate first and scan the small result with
:mod:`featurelab.operators.scan`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .position import with_position
from .scan import carry_forward, running_total
from .scan import ema as _ema

# Largest double whose square still rounds to a finite float32 (fixed value).
FLOAT32_SQUARE_LIMIT = 3.4028235677973366e38


def is_finite_report(v: Column) -> Column:
    """Finiteness as the collector tests it: the float32 square is finite."""
    return (v * v) < F.lit(FLOAT32_SQUARE_LIMIT)


def metric_moments(df: DataFrame, keys=("name",), value_col: str = "value",
                   contributes: Column | None = None) -> DataFrame:
    """Per key ``num`` (finite values), ``sum`` and ``sumsq`` over finite values.

    ``contributes`` (A11) restricts which rows add moments; keys still appear
    with zero moments when none of their rows contribute.
    """
    v = F.col(value_col).cast("double")
    ok = is_finite_report(v)
    if contributes is not None:
        ok = ok & contributes
    return (df.groupBy(*keys)
            .agg(F.count_if(ok).alias("num"),
                 F.coalesce(F.sum(F.when(ok, v)), F.lit(0.0)).alias("sum"),
                 F.coalesce(F.sum(F.when(ok, v * v)), F.lit(0.0)).alias("sumsq")))


def rank0_moments(df: DataFrame, keys=("name",), value_col: str = "value", rank_col: str = "rank") -> DataFrame:
    """As A9, only rank 0 contributes."""
    return metric_moments(df, keys, value_col, contributes=F.col(rank_col) == 0)


def summary_columns(num="num", s="sum", sq="sumsq") -> list[Column]:
    """A10: ``mean`` (NaN if num = 0) and population ``std`` (NaN if num = 0 or the
    sum is not finite, 0 if num = 1)."""
    n, sm, ssq = F.col(num).cast("double"), F.col(s), F.col(sq)
    mean = F.when(n == 0, F.lit(float("nan"))).otherwise(sm / n)
    finite_sum = (~F.isnan(sm)) & (F.abs(sm) != F.lit(float("inf")))
    var = F.greatest(ssq / n - (sm / n) * (sm / n), F.lit(0.0))
    std = (F.when((n == 0) | ~finite_sum, F.lit(float("nan")))
           .when(n == 1, F.lit(0.0))
           .otherwise(F.sqrt(var)))
    return [mean.alias("mean"), std.alias("std")]


def metric_summary(moments: DataFrame) -> DataFrame:
    """A10 over a moments table."""
    return moments.select("*", *summary_columns())


def metrics_map(summary: DataFrame, keys=()) -> DataFrame:
    """``map<name, struct<num, mean, std>>`` per group of ``keys``.

    The map holds one entry per metric name (names are a fixed vocabulary).
    """
    entry = F.struct(F.col("name"), F.struct(F.col("num"), F.col("mean"), F.col("std")))
    g = summary.groupBy(*keys) if keys else summary.groupBy()
    return g.agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"))


def cross_rank_mean(df: DataFrame, step_col: str = "step", name_col: str = "name",
                    value_col: str = "value") -> DataFrame:
    """Mean over ranks per step and metric."""
    return df.groupBy(step_col, name_col).agg(F.avg(value_col).alias("mean"),
                                              F.count(F.lit(1)).alias("n_ranks"))


def sync_group(df: DataFrame, order_cols: list[str], sync_col: str = "is_sync",
               out_col: str = "sync_group", key_cols: list[str] = ()) -> DataFrame:
    """Running count of sync flags strictly before the row."""
    flagged = df.withColumn("_fl_flag", F.col(sync_col).cast("double"))
    r = running_total(flagged, list(key_cols), order_cols, "_fl_flag", out_col, exclusive=True)
    return r.withColumn(out_col, F.col(out_col).cast("bigint")).drop("_fl_flag")


def microstep_rollup(df: DataFrame, order_cols: list[str], sync_col: str, sum_cols: list[str],
                     sync_only_cols: list[str] = (), key_cols: list[str] = ()) -> DataFrame:
    """Per optimiser step, sums over its micro-steps up to and including the sync row.

    ``sync_only_cols`` count only on the sync row (the EMA timer).  Micro-steps
    after the last sync never close a step and are dropped.
    """
    g = sync_group(df, order_cols, sync_col, "_fl_grp", list(key_cols))
    s = F.col(sync_col)
    aggs = [F.count(F.lit(1)).alias("n_micro"), F.max(s.cast("int")).alias("_closed")]
    aggs += [F.sum(F.col(c)).alias(c) for c in sum_cols]
    aggs += [F.coalesce(F.sum(F.when(s, F.col(c))), F.lit(0.0)).alias(c) for c in sync_only_cols]
    out = g.groupBy(*key_cols, "_fl_grp").agg(*aggs).where(F.col("_closed") == 1)
    return out.select(*key_cols, (F.col("_fl_grp") + 1).alias("step"), "n_micro",
                      *sum_cols, *sync_only_cols)


def check_same_names(df: DataFrame, rank_col: str = "rank", name_col: str = "name",
                     seq_col: str = "event_id") -> DataFrame:
    """Each rank's ordered name list (by first report) and whether all ranks agree.

    Lists are per rank over distinct names (a fixed vocabulary), so each
    collected list is bounded by the number of names, not by the rows.
    """
    first = df.groupBy(rank_col, name_col).agg(F.min(seq_col).alias("_first"))
    per_rank = first.groupBy(rank_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", name_col))),
                                 lambda x: x[name_col]), ",").alias("names"))
    distinct = per_rank.agg(F.count_distinct("names").alias("_n")).first()["_n"]
    return per_rank.withColumn("consistent", F.lit(distinct == 1))


def assert_same_names(df: DataFrame, rank_col: str = "rank", name_col: str = "name",
                      seq_col: str = "event_id") -> None:
    """A14, failing form: raise when ranks report different ordered name lists."""
    per_rank = check_same_names(df, rank_col, name_col, seq_col)
    bad = per_rank.where(~F.col("consistent")).limit(3).collect()
    if bad:
        raise ValueError(f"ranks report different metric names: {bad}")


def parameter_totals(df: DataFrame, group_col: str = "group", shape_col: str = "shape") -> DataFrame:
    """Elements per tensor (product of its shape), summed per group."""
    numel = F.aggregate(F.col(shape_col), F.lit(1).cast("bigint"), lambda acc, x: acc * x)
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_tensors"),
                                     F.sum(numel).alias("n_params"))


def moments_delta(snapshots: DataFrame, keep_previous: bool = False, update_col: str = "update",
                  name_col: str = "name") -> DataFrame:
    """Moments between consecutive updates from cumulative snapshots.

    A zero-count delta is hidden (mean NaN) or, with ``keep_previous``, the
    last non-zero delta is carried forward.  The previous snapshot of a name
    is found by global position (W1) and an equi-join on ``pos - 1``, so no
    task holds a whole name; the carry-forward is a distributed scan.
    """
    m = ("num", "sum", "sumsq")
    pos = with_position(snapshots.select(update_col, name_col, *m), [name_col, update_col], "_fl_pos")
    prev = pos.select(F.col(name_col).alias("_fl_pn"), (F.col("_fl_pos") + 1).alias("_fl_ppos"),
                      *[F.col(c).alias(f"_fl_p_{c}") for c in m])
    j = pos.join(prev, (F.col("_fl_pos") == F.col("_fl_ppos")) & (F.col(name_col) == F.col("_fl_pn")), "left")
    d = j.select(update_col, name_col,
                 *[(F.col(c) - F.coalesce(F.col(f"_fl_p_{c}"), F.lit(0))).alias(f"d_{c}") for c in m])
    live = F.col("d_num") != 0
    if keep_previous:
        d = carry_forward(d.withColumn("_fl_live", live), [name_col], [update_col],
                          [f"d_{c}" for c in m], "_fl_live", [f"c_{c}" for c in m])
        d = d.select(update_col, name_col, F.col("c_num").cast("bigint").alias("d_num"),
                     F.col("c_sum").alias("d_sum"), F.col("c_sumsq").alias("d_sumsq"))
    else:
        d = d.select(update_col, name_col,
                     *[F.when(live, F.col(f"d_{c}")).otherwise(F.lit(0)).alias(f"d_{c}") for c in m])
    return d.select(update_col, name_col, F.col("d_num").alias("num"), F.col("d_sum").alias("sum"),
                    F.col("d_sumsq").alias("sumsq")).select("*", *summary_columns())


#: updates that one row of the snapshot grid expands to
SNAPSHOT_BLOCK = 4096


def cumulative_snapshots(reports: DataFrame, update_col: str = "update", name_col: str = "name",
                         value_col: str = "value") -> DataFrame:
    """Cumulative collector state after each update for every name seen so far.

    Reports are pre-aggregated to one row per (update, name) first; the dense
    grid is generated per name from its first update to the last update, and
    the running sums are a distributed scan (a hot name spans many tasks).
    """
    per = metric_moments(reports, (update_col, name_col), value_col)
    last = per.agg(F.max(update_col).alias("m")).first()["m"]
    firsts = per.groupBy(name_col).agg(F.min(update_col).alias("_f"))
    # updates are generated block by block: names x blocks rows first, dealt over all tasks, then the updates of a block
    kind = per.schema[update_col].dataType
    step = F.lit(SNAPSHOT_BLOCK).cast(kind)
    starts = firsts.where(F.col("_f") <= F.lit(last)).select(name_col, F.explode(F.sequence(F.col("_f"), F.lit(last).cast(kind), step)).alias("_b")) \
        .repartition(name_col, "_b")
    grid = starts.select(name_col, F.explode(F.sequence("_b", F.least(F.col("_b") + step - 1, F.lit(last).cast(kind)))).alias(update_col))
    dense = grid.join(per, [update_col, name_col], "left").na.fill(0, ["num", "sum", "sumsq"])
    cum = running_total(dense, [name_col], [update_col], ["num", "sum", "sumsq"], ["c_num", "c_sum", "c_sumsq"])
    return cum.select(update_col, name_col, F.col("c_num").cast("bigint").alias("num"),
                      F.col("c_sum").alias("sum"), F.col("c_sumsq").alias("sumsq"))


def cadence(df: DataFrame, step_col: str, every: int) -> DataFrame:
    """P10: rows where ``step % every = 0 and step > 0``."""
    return df.where((F.pmod(F.col(step_col), F.lit(int(every))) == 0) & (F.col(step_col) > 0))


def select_metrics(df: DataFrame, name_col: str = "name", prefixes=("loss", "time_"), regex: str | None = None) -> DataFrame:
    """Keep names that start with any prefix, or, with ``regex``, whose whole name fits it."""
    if regex is not None:
        return df.where(F.col(name_col).rlike(f"^(?:{regex})$"))
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col(name_col).startswith(p)
    return df.where(cond)


def ema(df: DataFrame, key_cols: list[str], order_cols: list[str], value_col: str,
        decay: float = 0.9999, out_col: str = "ema") -> DataFrame:
    """W6 re-aimed to ordered metric series (see :func:`featurelab.operators.scan.ema`)."""
    return _ema(df, key_cols, order_cols, value_col, decay, out_col)
