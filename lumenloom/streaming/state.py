"""Keyed state with timers: the month's budget that stops its own stream, and routines that fire by their own clock.

The stream's checkpoint is the only state. Both need the RocksDB state store (``stateful``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenloom.operators import schedule

#: What a month came to: ``warning`` and ``hard_stop`` when a level is first reached, ``closed`` when the month is over.
BUDGET = "budget string, month timestamp, event string, observed double, cap double, at timestamp"
LEVELS = (None, "warning", "hard_stop")
FIRED = "name string, now timestamp, recent timestamp, action string"


class BudgetReached(RuntimeError):
    """The stream stopped itself: a budget's month is at its cap."""


def stateful(spark: SparkSession) -> None:
    """Use the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Month(StatefulProcessor):
    """Running total of one budget's month. Events count once by id, in the order of time within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "observed double, level int, cap double")
        self.seen = handle.getMapState("seen", "event_id string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        budget, month = key
        began = self.total.exists()
        observed, level, cap = self.total.get() if began else (0.0, 0, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["occurred_at", "event_id"]).itertuples():
            if self.seen.containsKey((r.event_id,)):
                continue
            self.seen.updateValue((r.event_id,), (1,))
            observed += float(r.cents)
            cap = float(r.cap)  # the newest policy counts
            now = 2 if observed >= cap else 1 if observed >= r.warn else 0
            for reached in range(level + 1, now + 1):
                out.append((budget, month, LEVELS[reached], observed, cap, r.occurred_at))
            level = max(level, now)
        self.total.update((observed, level, cap))
        if not began:
            over = (pd.Timestamp(month) + pd.offsets.MonthBegin(1)).tz_localize("UTC")
            self.handle.registerTimer(int(over.timestamp() * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BUDGET.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        budget, month = key
        observed, _, cap = self.total.get()
        over = pd.Timestamp(month) + pd.offsets.MonthBegin(1)
        self.total.clear()
        self.seen.clear()
        yield pd.DataFrame([(budget, month, "closed", observed, cap, over)], columns=[c.split()[0] for c in BUDGET.split(", ")])


def month_budgets(events: DataFrame, policies: DataFrame, late: str = "1 day") -> DataFrame:
    """Levels that budgets reach, from a stream of ``events`` (event_id, budget, cents, occurred_at).

    ``policies``: one row a budget with cap_cents and warn_pct; the warning level is rounded up. A month's
    state ends when the watermark passes its end; an event that comes later still is dropped with its month.
    Events without a policy, a time or an id do not count.
    """
    warn = F.ceil(F.col("cap_cents") * F.col("warn_pct") / 100).cast("double")
    rules = policies.select("budget", F.col("cap_cents").cast("double").alias("cap"), warn.alias("warn"))
    held = events.where("occurred_at IS NOT NULL AND event_id IS NOT NULL AND budget IS NOT NULL").withWatermark("occurred_at", late)
    joined = held.join(rules, "budget").select("budget", F.date_trunc("month", "occurred_at").alias("month"), F.col("event_id").cast("string").alias("event_id"), F.coalesce("cents", F.lit(0)).cast("double").alias("cents"), "occurred_at", "cap", "warn")
    return joined.groupBy("budget", "month").transformWithStateInPandas(_Month(), BUDGET, "Append", "EventTime")


def stop_at_cap(levels: DataFrame, folder: str, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
    """A writer of ``month_budgets`` that keeps every level and ends the query once a month that is still on is at its cap.

    A batch writes its own folder, over what an earlier attempt left; then it looks at all levels, so a query that
    starts again in the same month stops again, and in the next month goes on.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/levels/batch={number}")
        month = now().strftime("%Y-%m")
        held = batch.sparkSession.read.schema(BUDGET).parquet(f"{folder}/levels/batch=*")
        stopped = held.where((F.col("event") == "hard_stop") & (F.date_format("month", "yyyy-MM") == month)).select("budget").distinct().collect()  # one row a budget
        if stopped:
            raise BudgetReached(f"at their cap in {month}: {', '.join(sorted(r['budget'] for r in stopped))}")

    return levels.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")


@dataclass(frozen=True)
class Routine:
    name: str
    cron: str
    zone: str = "UTC"
    enabled: bool = True


class _LastFired(StatefulProcessor):
    """When one routine was last acknowledged. The first sight starts its clock; then one make-up at most is due at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fired timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()[0] if self.last.exists() else None
        last = None if held is None else pd.Timestamp(held)
        out = []
        for r in pd.concat(list(rows)).sort_values("now").itertuples():
            action = "wait"
            if r.enabled and not pd.isna(r.recent):
                action = "start" if last is None else "fire" if r.recent > last else "wait"
            if action != "wait":
                last = r.now
            out.append((key[0], r.now, None if pd.isna(r.recent) else r.recent, action))
        if last is not None:
            self.last.update((pd.Timestamp(last).to_pydatetime(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FIRED.split(", ")])


def fired(clock: DataFrame, routines: Sequence[Routine], days: int = 14) -> DataFrame:
    """What each of the routines does at each time of a stream ``clock`` (now): ``start``, ``fire`` or ``wait``.

    The rule is that of ``schedule.due``; ``now`` is UTC, and a routine's cron speaks of its own zone.
    """

    def recent(r: Routine):
        tick = schedule.recent_tick(r.cron, F.from_utc_timestamp("now", r.zone), days)
        return F.struct(F.lit(r.name).alias("name"), F.to_utc_timestamp(tick, r.zone).alias("recent"), F.lit(r.enabled).alias("enabled"))

    each = clock.select("now", F.explode(F.array(*map(recent, routines))).alias("r")).select("r.name", "now", "r.recent", "r.enabled")
    return each.groupBy("name").transformWithStateInPandas(_LastFired(), FIRED, "Append", "None")
