"""M3, waiting form: a step is reported once every rank has reported, with the running average kept as state.

The state of a metric name is the steps that still wait for ranks, the last step
reported, and the exponential moving average; a timer per step gives up on ranks
that stay away.  The rows of a name meet in one task per micro-batch; what the
state holds of a name is bounded by the steps that ranks lie apart.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "name string, step long, mean double, n_ranks int, complete boolean, ema double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StepReports(StatefulProcessor):
    """Steps of one name in order: each once its ``world`` ranks are there, or its timer has run out."""

    def __init__(self, world: int, decay: float):
        self.world, self.decay = world, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "step long", "ranks array<int>, total double, expired boolean")
        self.reported = handle.getValueState("reported", "step long, ema double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self._last()
        new: dict[int, dict[int, float]] = {}
        for pdf in rows:
            for step, rank, value in zip(pdf["step"].tolist(), pdf["rank"].tolist(), pdf["value"].tolist()):
                if last is None or step > last:  # reported steps are settled
                    new.setdefault(step, {}).setdefault(rank, value)
        for step, reports in new.items():
            if self.pending.containsKey((step,)):
                ranks, total, expired = self.pending.getValue((step,))
                ranks = list(ranks)
            else:
                ranks, total, expired = [], 0.0, False
                self.handle.registerTimer(step_ms(step))
            for rank, value in sorted(reports.items()):
                if rank not in ranks:  # a rank's first report counts
                    ranks.append(rank)
                    total += value
            self.pending.updateValue((step,), (ranks, total, expired))
        yield self._report(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        for (s,), (ranks, total, _) in list(self.pending.iterator()):
            if s <= step:
                self.pending.updateValue((s,), (list(ranks), total, True))
        yield self._report(key)

    def _last(self) -> int | None:
        return self.reported.get()[0] if self.reported.exists() else None

    def _report(self, key) -> pd.DataFrame:
        """The steps that nothing before them keeps waiting, in order."""
        out = []
        for step, ranks, total, expired in sorted((s, len(r), t, e) for (s,), (r, t, e) in list(self.pending.iterator())):
            if ranks < self.world and not expired:
                break
            mean = total / ranks
            ema = self.decay * self.reported.get()[1] + (1 - self.decay) * mean if self.reported.exists() else mean
            self.reported.update((step, ema))
            self.pending.removeKey((step,))
            if not expired:
                self.handle.deleteTimer(step_ms(step))
            out.append((key[0], step, mean, ranks, ranks == self.world, ema))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"step": "int64", "mean": "float64", "n_ranks": "int32", "complete": "bool", "ema": "float64"})

    def close(self) -> None:
        pass


def step_ms(step: int) -> int:
    """Event time of a step: step s is second s + 1 (a timer at 0 would never run)."""
    return (step + 1) * 1000


def stream_complete_steps(stream: DataFrame, world: int, late_steps: int = 1000, decay: float = 0.99) -> DataFrame:
    """M3: ``name, step, rank, value`` reports to one row per step, in step order per name.

    A step is reported when all ``world`` ranks have reported it and the steps of its
    name before it are reported; when the watermark, the latest step less
    ``late_steps``, has passed it, it is reported with the ranks there are
    (``complete`` is false), and ranks that come later are dropped.  The query must
    start with the state store ``PROVIDER``, which has timers.  ``ema`` is the moving average of the means up to it.
    """
    ev = stream.select(F.col("name").cast("string").alias("name"), F.col("step").cast("long").alias("step"), F.col("rank").cast("int").alias("rank"),
                       F.col("value").cast("double").alias("value"), F.timestamp_seconds(F.col("step") + 1).alias("at"))
    ev = ev.where("name is not null and step is not null and rank is not null and value is not null")
    return ev.withWatermark("at", f"{int(late_steps)} seconds").groupBy("name").transformWithStateInPandas(
        StepReports(world, decay), SCHEMA, "Append", "EventTime")


def append_available_now(df: DataFrame, dest: str, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run an append-mode stream over what is available into ``dest`` (Parquet, exactly once) and read all of it.

    Only this stream gets the state store ``PROVIDER``; a stream keeps the store of its checkpoint."""
    from .jobs import checkpoint_path
    conf, setting = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting, None)
    conf.set(setting, PROVIDER)
    try:
        q = (df.writeStream.format("parquet").outputMode("append").option("path", dest)
             .option("checkpointLocation", checkpoint or checkpoint_path(df.sparkSession, name)).trigger(availableNow=True).start())
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(dest)
