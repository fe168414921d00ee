"""When to stop a stage that makes no progress: strikes in a row, or silence.

Every pass of a stage either writes something, which clears its strikes, or is a strike:
against the quota if it was blocked, else an idle one.  Enough strikes of a kind in a row
stop the stage, and so does silence, which no row can tell: in a stream a timer fires for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Strikes in a row that stop a stage.
QUOTA_STRIKES, IDLE_STRIKES = 5, 6
QUOTA, IDLE, SILENCE = "quota", "idle", "silence"


def stops(passes: DataFrame, key: str, at: str, written: str, blocked: str, order: str, silence: Column | None = None, quota: int = QUOTA_STRIKES, idle: int = IDLE_STRIKES) -> DataFrame:
    """``key, at, reason``: where each stage of a finished log is stopped first; none without a stop.

    ``order`` settles passes of one time.  With ``silence`` (an interval) a stage is also
    stopped that long after a pass that no other follows in time, if the log goes on so long.
    At one time strikes come before silence.  NULL in ``written`` counts as nothing, in
    ``blocked`` as not blocked; passes without a time are left out.
    """
    rows = passes.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(order).alias("o"), (F.coalesce(F.col(written), F.lit(0)) > 0).alias("wrote"), F.coalesce(F.col(blocked), F.lit(False)).alias("blocked"))
    by = Window.partitionBy("k").orderBy("t", "o")
    run = rows.withColumn("run", F.sum(F.col("wrote").cast("int")).over(by))
    within = Window.partitionBy("k", "run").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    struck = lambda c: F.sum((c & ~F.col("wrote")).cast("int")).over(within)
    counted = run.withColumns({"q": struck(F.col("blocked")), "i": struck(~F.col("blocked")), "next": F.lead("t").over(by)})
    hit = F.when(F.col("q") >= quota, QUOTA).when(F.col("i") >= idle, IDLE)
    found = counted.where(hit.isNotNull()).select("k", F.col("t").alias("at"), hit.alias("reason"), F.lit(0).alias("late"))
    if silence is not None:
        ends = rows.agg(F.max("t").alias("log_end"))
        due = F.col("t") + silence
        quiet = counted.crossJoin(F.broadcast(ends)).where(F.coalesce("next", "log_end") >= due).where(F.col("next").isNull() | (F.col("next") > due))  # one row
        found = found.unionByName(quiet.select("k", due.alias("at"), F.lit(SILENCE).alias("reason"), F.lit(1).alias("late")))
    first = found.groupBy("k").agg(F.min(F.struct("at", "late", "reason")).alias("f"))
    return first.select(F.col("k").alias(key), F.col("f.at").alias("at"), F.col("f.reason").alias("reason"))


class Strikes(StatefulProcessor):
    """State of one stage: strikes in a row of both kinds and whether it has been stopped.

    Rows of a stage come as ``at, written, blocked``; the timer is moved on by every row, and
    state that nothing touches for ``keep_ms`` of processing time is dropped where the time mode
    allows it.
    """

    def __init__(self, key: str, silence_ms: int, quota: int = QUOTA_STRIKES, idle: int = IDLE_STRIKES):
        self.key, self.silence_ms, self.quota, self.idle = key, silence_ms, quota, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("strikes", "quota int, idle int, last bigint, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quota, idle, last, stopped = self.state.get() if self.state.exists() else (0, 0, None, False)
        out = []
        passes = pd.concat(list(rows)).sort_values("at", kind="stable")
        for at, written, blocked in zip(passes["at"], passes["written"].fillna(0), passes["blocked"].fillna(False)):
            ms = int(pd.Timestamp(at).value // 1_000_000)
            last = ms if last is None else max(last, ms)
            if written > 0:
                quota = idle = 0
                continue
            quota, idle = quota + bool(blocked), idle + (not blocked)
            if not stopped and (quota >= self.quota or idle >= self.idle):
                out.append((key[0], at, QUOTA if quota >= self.quota else IDLE))
                stopped = True
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not stopped:
            self.handle.registerTimer(last + self.silence_ms)
        self.state.update((quota, idle, last, stopped))
        yield pd.DataFrame(out, columns=[self.key, "at", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        quota, idle, last, _ = self.state.get()
        self.state.update((quota, idle, last, True))
        yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), SILENCE)], columns=[self.key, "at", "reason"])

    def close(self) -> None:
        pass


def watch(passes: DataFrame, key: str, silence_ms: int, lateness: str = "10 minutes", quota: int = QUOTA_STRIKES, idle: int = IDLE_STRIKES) -> DataFrame:
    """``key, at, reason``: each stage's first stop, as its stream of ``key, at, written, blocked`` goes on.

    Silence is told by event time: once the watermark has passed a stage's last row by
    ``silence_ms``, whichever stage moves the watermark on.  Needs the RocksDB state store.
    """
    kind = dict(passes.dtypes)[key]
    rows = passes.select(key, "at", "written", "blocked").withWatermark("at", lateness)
    return rows.groupBy(key).transformWithStateInPandas(Strikes(key, silence_ms, quota, idle), f"`{key}` {kind}, at timestamp, reason string", "Append", "EventTime")
