"""Registered queries of the metric family."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import fixtures as fx
from .q_evaluate import rnd

EMA_DECAY = 0.99
UPDATE_EVERY = 7  # reports per collector update in the W3 fixture


def _named(df):
    """Metric names with the training-log prefixes (for P11 and F12)."""
    return df.withColumn("name", F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("loss_"), "name"))
                         .when(F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit("time_"), "name"))
                         .otherwise(F.col("name")))


def _moment_cols():
    return ["num", rnd("sum", 4).alias("sum"), rnd("sumsq", 2).alias("sumsq"),
            rnd("mean").alias("mean"), rnd("std").alias("std")]


def q_moments(spark, sf):
    m = M.metric_summary(M.metric_moments(fx.metric_reports(spark, sf)))
    return m.select("name", *_moment_cols())


def q_moments_by_rank(spark, sf):
    m = M.metric_summary(M.metric_moments(fx.metric_reports(spark, sf), ("rank", "name")))
    return m.select("rank", "name", *_moment_cols())


def q_rank0(spark, sf):
    m = M.metric_summary(M.rank0_moments(fx.metric_reports(spark, sf)))
    return m.select("name", *_moment_cols())


def q_metrics_map(spark, sf):
    s = M.metric_summary(M.metric_moments(fx.metric_reports(spark, sf), ("rank", "name")))
    mp = M.metrics_map(s, ["rank"])
    return mp.select("rank", *[rnd(F.element_at("metrics", n)["mean"]).alias(f"{n}_mean")
                               for n in ("click", "view", "error", "signup", "purchase")],
                     F.size("metrics").alias("n_names"))


def q_cross_rank_mean(spark, sf):
    m = M.cross_rank_mean(fx.step_log(spark, sf))
    return m.select("step", "name", rnd("mean").alias("mean"), "n_ranks")


def q_sync_group(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", (F.pmod("event_id", F.lit(4)) == 3).alias("is_sync"))
    return M.sync_group(ev, ["event_id"], "is_sync").select("event_id", "sync_group")


def _rollup_input(spark, sf):
    ev = fx.table(spark, sf, "events")
    return ev.select("event_id", (F.pmod("event_id", F.lit(4)) == 3).alias("is_sync"),
                     F.col("value").alias("time_forward"), (F.col("value") / 2).alias("time_backward"),
                     F.col("value").alias("time_ema"))


def q_microstep_rollup(spark, sf):
    r = M.microstep_rollup(_rollup_input(spark, sf), ["event_id"], "is_sync",
                           ["time_forward", "time_backward"], ["time_ema"])
    return r.select("step", "n_micro", rnd("time_forward").alias("time_forward"),
                    rnd("time_backward").alias("time_backward"), rnd("time_ema").alias("time_ema"))


def q_check_names(spark, sf):
    return M.check_same_names(fx.metric_reports(spark, sf))


def q_param_totals(spark, sf):
    return M.parameter_totals(fx.param_shapes(spark, sf))


def _reports_with_updates(spark, sf):
    return fx.metric_reports(spark, sf).withColumn(
        "update", F.floor(F.col("event_id") / UPDATE_EVERY).cast("bigint"))


def _delta_cols():
    return ["update", "name", "num", rnd("sum", 4).alias("sum"), rnd("mean").alias("mean"),
            rnd("std").alias("std")]


def q_moments_delta(spark, sf):
    snaps = M.cumulative_snapshots(_reports_with_updates(spark, sf))
    return M.moments_delta(snaps, keep_previous=False).select(*_delta_cols())


def q_moments_delta_keep(spark, sf):
    snaps = M.cumulative_snapshots(_reports_with_updates(spark, sf))
    return M.moments_delta(snaps, keep_previous=True).select(*_delta_cols())


def q_ema(spark, sf):
    e = M.ema(fx.metric_series(spark, sf), ["name"], ["seq"], "value", EMA_DECAY)
    return e.select("name", "seq", rnd("ema").alias("ema"))


def q_cadence(spark, sf):
    return M.cadence(fx.step_log(spark, sf), "step", 100).select("event_id", "step")


def q_select_metrics(spark, sf):
    s = M.select_metrics(_named(fx.metric_reports(spark, sf)))
    return s.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "metrics_moments": q_moments,
    "metrics_moments_by_rank": q_moments_by_rank,
    "metrics_rank0": q_rank0,
    "metrics_map": q_metrics_map,
    "metrics_cross_rank_mean": q_cross_rank_mean,
    "metrics_sync_group": q_sync_group,
    "metrics_microstep_rollup": q_microstep_rollup,
    "metrics_check_names": q_check_names,
    "metrics_param_totals": q_param_totals,
    "metrics_moments_delta": q_moments_delta,
    "metrics_moments_delta_keep": q_moments_delta_keep,
    "metrics_ema": q_ema,
    "metrics_cadence": q_cadence,
    "metrics_select": q_select_metrics,
}

# ---------------------------------------------------------------- oracles
_FIN = "(value * value < 3.4028235677973366e38)"
_MOM = f"""count(*) FILTER (WHERE {_FIN}) AS num,
       coalesce(sum(value) FILTER (WHERE {_FIN}), 0.0) AS sum,
       coalesce(sum(value * value) FILTER (WHERE {_FIN}), 0.0) AS sumsq"""
_SUMMARY = """num, round0(sum, 4) AS sum, round0(sumsq, 2) AS sumsq,
       round0(CASE WHEN num = 0 THEN CAST('NaN' AS DOUBLE) ELSE sum / num END, 6) AS mean,
       round0(CASE WHEN num = 0 OR isnan(sum) OR isinf(sum) THEN CAST('NaN' AS DOUBLE)
                   WHEN num = 1 THEN 0.0
                   ELSE sqrt(greatest(sumsq / num - (sum / num) * (sum / num), 0.0)) END, 6) AS std"""

MOMENTS_SQL = f"SELECT name, {_SUMMARY} FROM (SELECT name, {_MOM} FROM ({fx.METRIC_REPORTS_SQL}) GROUP BY name)"
MOMENTS_BY_RANK_SQL = (f"SELECT rank, name, {_SUMMARY} FROM (SELECT rank, name, {_MOM} "
                       f"FROM ({fx.METRIC_REPORTS_SQL}) GROUP BY rank, name)")
_FIN0 = f"({_FIN} AND rank = 0)"
RANK0_SQL = f"""SELECT name, {_SUMMARY} FROM (SELECT name, count(*) FILTER (WHERE {_FIN0}) AS num,
       coalesce(sum(value) FILTER (WHERE {_FIN0}), 0.0) AS sum,
       coalesce(sum(value * value) FILTER (WHERE {_FIN0}), 0.0) AS sumsq
FROM ({fx.METRIC_REPORTS_SQL}) GROUP BY name)"""

METRICS_MAP_SQL = f"""
WITH m AS (SELECT rank, name, {_MOM} FROM ({fx.METRIC_REPORTS_SQL}) GROUP BY rank, name),
s AS (SELECT rank, name, CASE WHEN num = 0 THEN CAST('NaN' AS DOUBLE) ELSE sum / num END AS mean FROM m)
SELECT rank,
  round0(max(mean) FILTER (WHERE name = 'click'), 6) AS click_mean,
  round0(max(mean) FILTER (WHERE name = 'view'), 6) AS view_mean,
  round0(max(mean) FILTER (WHERE name = 'error'), 6) AS error_mean,
  round0(max(mean) FILTER (WHERE name = 'signup'), 6) AS signup_mean,
  round0(max(mean) FILTER (WHERE name = 'purchase'), 6) AS purchase_mean,
  CAST(count(*) AS INTEGER) AS n_names
FROM s GROUP BY rank
"""

CROSS_RANK_SQL = f"""SELECT step, name, round0(avg(value), 6) AS mean, count(*) AS n_ranks
FROM ({fx.STEP_LOG_SQL}) GROUP BY step, name"""

SYNC_GROUP_SQL = """
SELECT event_id, CAST(coalesce(sum(CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END)
       OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sync_group
FROM events
"""

ROLLUP_SQL = """
WITH g AS (
  SELECT event_id, event_id % 4 = 3 AS is_sync, value,
         coalesce(sum(CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END)
           OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
  FROM events)
SELECT CAST(grp + 1 AS BIGINT) AS step, count(*) AS n_micro, round0(sum(value), 6) AS time_forward,
       round0(sum(value / 2), 6) AS time_backward,
       round0(coalesce(sum(value) FILTER (WHERE is_sync), 0.0), 6) AS time_ema
FROM g GROUP BY grp HAVING bool_or(is_sync)
"""

CHECK_NAMES_SQL = f"""
WITH f AS (SELECT rank, name, min(event_id) AS first FROM ({fx.METRIC_REPORTS_SQL}) GROUP BY rank, name),
p AS (SELECT rank, string_agg(name, ',' ORDER BY first, name) AS names FROM f GROUP BY rank)
SELECT rank, names, (SELECT count(DISTINCT names) FROM p) = 1 AS consistent FROM p
"""

PARAM_TOTALS_SQL = f"""
SELECT "group", count(*) AS n_tensors, CAST(sum(shape[1] * shape[2]) AS BIGINT) AS n_params
FROM ({fx.PARAM_SHAPES_SQL}) GROUP BY "group"
"""


def _delta_sql(keep: bool) -> str:
    carry = ("coalesce(last(CASE WHEN dn <> 0 THEN {c} END IGNORE NULLS) OVER "
             "(PARTITION BY name ORDER BY \"update\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)")
    plain = "CASE WHEN dn <> 0 THEN {c} ELSE 0 END"
    f = carry if keep else plain
    return f"""
WITH r AS (SELECT *, event_id // {UPDATE_EVERY} AS "update" FROM ({fx.METRIC_REPORTS_SQL})),
per AS (SELECT "update", name, {_MOM} FROM r GROUP BY "update", name),
firsts AS (SELECT name, min("update") AS f FROM per GROUP BY name),
grid AS (SELECT name, u AS "update" FROM firsts, range(f, (SELECT max("update") FROM per) + 1) t(u)),
dense AS (SELECT g."update", g.name, coalesce(p.num, 0) AS num, coalesce(p.sum, 0.0) AS sum,
                 coalesce(p.sumsq, 0.0) AS sumsq
          FROM grid g LEFT JOIN per p ON g."update" = p."update" AND g.name = p.name),
cum AS (SELECT "update", name,
          sum(num) OVER w AS num, sum(sum) OVER w AS sum, sum(sumsq) OVER w AS sumsq
        FROM dense WINDOW w AS (PARTITION BY name ORDER BY "update" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT "update", name,
        num - coalesce(lag(num) OVER w, 0) AS dn,
        sum - coalesce(lag(sum) OVER w, 0) AS ds,
        sumsq - coalesce(lag(sumsq) OVER w, 0) AS dq
      FROM cum WINDOW w AS (PARTITION BY name ORDER BY "update")),
k AS (SELECT "update", name, {f.format(c='dn')} AS num, {f.format(c='ds')} AS sum, {f.format(c='dq')} AS sumsq FROM d)
SELECT CAST("update" AS BIGINT) AS "update", name, CAST(num AS BIGINT) AS num, round0(sum, 4) AS sum,
       round0(CASE WHEN num = 0 THEN CAST('NaN' AS DOUBLE) ELSE sum / num END, 6) AS mean,
       round0(CASE WHEN num = 0 OR isnan(sum) OR isinf(sum) THEN CAST('NaN' AS DOUBLE)
                   WHEN num = 1 THEN 0.0
                   ELSE sqrt(greatest(sumsq / num - (sum / num) * (sum / num), 0.0)) END, 6) AS std
FROM k
"""


EMA_SQL = f"""
WITH s AS (SELECT event_type AS name, event_id AS seq, value,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS t FROM events),
c AS (SELECT name, seq, t, value,
             first_value(value) OVER (PARTITION BY name ORDER BY t) AS x0,
             sum(CASE WHEN t = 0 THEN 0.0 ELSE pow({EMA_DECAY}, -t) * value END)
               OVER (PARTITION BY name ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc
      FROM s)
SELECT name, seq, round0(pow({EMA_DECAY}, t) * (x0 + (1 - {EMA_DECAY}) * acc), 6) AS ema FROM c
"""

CADENCE_SQL = f"SELECT event_id, step FROM ({fx.STEP_LOG_SQL}) WHERE step % 100 = 0 AND step > 0"

SELECT_SQL = f"""
SELECT name, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'loss_' || name WHEN event_id % 3 = 1 THEN 'time_' || name
              ELSE name END AS name FROM ({fx.METRIC_REPORTS_SQL}))
WHERE starts_with(name, 'loss') OR starts_with(name, 'time_') GROUP BY name
"""

ORACLES = {
    "metrics_moments": MOMENTS_SQL,
    "metrics_moments_by_rank": MOMENTS_BY_RANK_SQL,
    "metrics_rank0": RANK0_SQL,
    "metrics_map": METRICS_MAP_SQL,
    "metrics_cross_rank_mean": CROSS_RANK_SQL,
    "metrics_sync_group": SYNC_GROUP_SQL,
    "metrics_microstep_rollup": ROLLUP_SQL,
    "metrics_check_names": CHECK_NAMES_SQL,
    "metrics_param_totals": PARAM_TOTALS_SQL,
    "metrics_moments_delta": _delta_sql(False),
    "metrics_moments_delta_keep": _delta_sql(True),
    "metrics_ema": EMA_SQL,
    "metrics_cadence": CADENCE_SQL,
    "metrics_select": SELECT_SQL,
}
