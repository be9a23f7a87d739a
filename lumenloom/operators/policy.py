"""Source policy: which sources to run, from cumulative keep rates."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN, REPROBE, SKIP = "run", "reprobe", "muted_skip"


@dataclass(frozen=True)
class Policy:
    min_seen: int = 20
    keep_threshold: float = 0.08
    reprobe_every: int = 4


@dataclass
class State:
    """Running counters of one (routine, source)."""

    seen: int = 0
    kept: int = 0
    runs: int = 0
    muted: bool = False
    skips: int = 0

    def step(self, policy: Policy, seen: int, kept: int) -> str:
        """Decide, then update with what the source gave if it was run; returns the decision."""
        decision = RUN if not self.muted else REPROBE if self.skips + 1 >= policy.reprobe_every else SKIP
        if decision == SKIP:
            self.skips += 1
        else:
            self.seen, self.kept, self.runs, self.skips = self.seen + seen, self.kept + kept, self.runs + 1, 0
            self.muted = self.seen >= policy.min_seen and self.kept / self.seen < policy.keep_threshold
        return decision


def quality(papers: DataFrame, sources: str, kept: Column) -> DataFrame:
    """source, seen, kept, rate of papers with an array of sources and a keep condition; a paper counts once a source."""
    each = papers.select(F.explode(F.array_distinct(F.col(sources))).alias("source"), kept.alias("keep"))
    found = each.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.count_if("keep").alias("kept"))
    return found.withColumn("rate", F.try_divide(F.col("kept").cast("double"), F.col("seen").cast("double")))


def mute(stats: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Stats with the mute flag; a rate equal to the threshold does not mute."""
    return stats.withColumn("muted", (F.col("seen") >= policy.min_seen) & (F.col("rate") < policy.keep_threshold))


def decide(stats: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Stats (muted, skips) with the next decision."""
    due = F.col("skips") + 1 >= policy.reprobe_every
    return stats.withColumn("decision", F.when(~F.col("muted"), RUN).when(due, REPROBE).otherwise(SKIP))


def replay(steps: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions along ordered steps (routine, source, step, seen, kept), one fold a (routine, source)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for r in pdf.sort_values("step").itertuples():
            decision = state.step(policy, int(r.seen), int(r.kept))
            out.append((r.routine, r.source, r.step, decision, state.seen, state.kept, state.runs, state.muted, state.skips))
        return pd.DataFrame(out, columns=["routine", "source", "step", "decision", "total_seen", "total_kept", "runs", "muted", "skips"])

    shape = "routine string, source string, step int, decision string, total_seen long, total_kept long, runs long, muted boolean, skips long"
    return steps.groupBy("routine", "source").applyInPandas(run, shape)
