"""Streams: link-once, running spend, the source policy as keyed state, incident hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenloom.operators.policy import Policy, State


def link_once(stream: DataFrame, keys: list[str], ts: str, late: str = "14 days") -> DataFrame:
    """Each key once within the watermark; the lookback of acquisition overlaps, so repeats are expected."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def spend(stream: DataFrame, ts: str, key: str, amount: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sums by key and event-time window; state is dropped behind the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), key).agg(F.sum(amount).alias("spent"), F.count(F.lit(1)).alias("n"))


_OUT = "routine string, source string, step int, decision string, seen long, kept long, runs long, muted boolean, skips long"
_STATE = "seen long, kept long, runs long, muted boolean, skips long"


def source_policy(stream: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions for steps (routine, source, step, seen, kept) of each (routine, source), steps of a batch in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = State(*held.get) if held.exists else State()
        steps = pd.concat(list(batches)).sort_values("step")
        out = []
        for r in steps.itertuples():
            decision = state.step(policy, int(r.seen), int(r.kept))
            out.append((*key, r.step, decision, state.seen, state.kept, state.runs, state.muted, state.skips))
        held.update((state.seen, state.kept, state.runs, state.muted, state.skips))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return stream.groupBy("routine", "source").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def with_gate(stream: DataFrame, check: Callable[[DataFrame], bool], write: Callable[[DataFrame, int], None]):
    """A foreachBatch writer that writes every batch and then fails the query if ``check`` says that a cap is reached."""

    def each(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if not check(batch):
            raise RuntimeError("budget reached")

    return stream.writeStream.foreachBatch(each)
