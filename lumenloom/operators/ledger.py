"""Cost ledger: an append-only fact table and the views over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a cache write costs this much of the input rate.
CACHE_WRITE_FACTOR = 1.25


def cents(inp: Column, out: Column, read: Column, write: Column, in_rate: Column, out_rate: Column, read_rate: Column, reported_usd: Column | None = None) -> Column:
    """Cost in cents from token counts and rates per million tokens; a reported dollar cost wins, unknown rates give 0."""
    computed = (inp * in_rate + write * in_rate * CACHE_WRITE_FACTOR + read * read_rate + out * out_rate) / 1_000_000
    computed = F.coalesce(computed, F.lit(0.0))
    return computed if reported_usd is None else F.coalesce(reported_usd * 100, computed)


def priced(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """Events (model, input_tokens, output_tokens, cached_input_tokens, cache_creation_tokens, total_cost_usd) with
    cost_cents and cost_source. ``pricing``: one row a model (a dimension, so it is left to Spark to broadcast)."""
    joined = events.join(pricing, "model", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = cents(n("input_tokens"), n("output_tokens"), n("cached_input_tokens"), n("cache_creation_tokens"), F.col("input_cents_per_mtok"), F.col("output_cents_per_mtok"), F.col("cached_input_cents_per_mtok"), F.col("total_cost_usd"))
    source = F.when(F.col("total_cost_usd").isNotNull(), "sdk_reported").otherwise("computed")
    return joined.select(*events.columns, cost.alias("cost_cents"), source.alias("cost_source"))


def rollup(events: DataFrame, keys: list[str], amounts: dict[str, str]) -> DataFrame:
    """Sums by key: ``amounts`` maps result names to columns."""
    return events.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in amounts.items()])


def month_to_date(events: DataFrame, now: Column, ts: str, amount: str) -> DataFrame:
    """One row: the month's sum up to its end from the month start of ``now``; 0 without events."""
    return events.where(F.col(ts) >= F.date_trunc("month", now)).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("observed"))


def budget_state(observed: DataFrame, cap: int, warn_pct: int, hard_stop: bool = True) -> DataFrame:
    """``observed`` rows with cap, warn (rounded up), tripped (null, warning, hard_stop), ok and utilization (0 without a cap)."""
    warn = -(-cap * warn_pct // 100)
    o = F.col("observed")
    tripped = F.when(o >= cap, "hard_stop").when(o >= warn, "warning")
    done = observed.withColumn("cap", F.lit(cap)).withColumn("warn", F.lit(warn)).withColumn("tripped", tripped)
    done = done.withColumn("ok", ~(F.coalesce(F.col("tripped"), F.lit("")) == "hard_stop") | F.lit(not hard_stop))
    return done.withColumn("utilization", F.coalesce(F.try_divide(o.cast("double"), F.lit(cap).cast("double")), F.lit(0.0)))


def open_incidents(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Incidents to append: the first of each (threshold, window_start) that is not open yet."""
    keys = ["threshold", "window_start"]
    first = found.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in found.columns if c not in keys]), "opened_at").alias("x")).select(*keys, "x.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def running_incidents(events: DataFrame, ts: str, amount: str, caps: dict[str, float]) -> DataFrame:
    """First day of each month on which the month's running sum reaches each threshold.

    Days are summed before the running window, so a window partition holds one month's days.
    """
    days = events.groupBy(F.date_trunc("day", F.col(ts)).alias("day")).agg(F.sum(amount).alias("spent"))
    month = F.date_trunc("month", F.col("day"))
    upto = F.sum("spent").over(Window.partitionBy(month).orderBy("day"))
    running = days.withColumn("window_start", month).withColumn("observed", upto)
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("threshold"), F.lit(float(v)).alias("cap")) for n, v in caps.items()]))
    crossed = running.withColumn("level", levels).where(F.col("observed") >= F.col("level.cap"))
    return crossed.groupBy(F.col("level.threshold").alias("threshold"), "window_start").agg(F.min("day").alias("opened_at"), F.min_by("observed", "day").alias("observed"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (give a unique tie-breaker last)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of equal key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def coalesce_update(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join that overwrites ``columns`` where the change is not null."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in table.columns])


def split_tokens(total: Column, read: Column, created: Column) -> Column:
    """Regular input tokens of a usage report that counts cache reads and writes in its total."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.greatest(n(total) - n(read) - n(created), F.lit(0))


def start_runs(new: DataFrame, now: Column) -> DataFrame:
    """Run rows for ``new`` (project, routine, invocation, id): running; a run without id is named after its routine and the time."""
    name = F.concat(F.coalesce("routine", F.lit("adhoc")), F.lit("-"), F.date_format(now, "yyyyMMdd'T'HHmmss'Z'"))
    return new.select(F.coalesce("id", name).alias("id"), "routine", "project", F.coalesce("invocation", F.lit("manual")).alias("invocation"), F.lit("running").alias("status"), now.alias("started_at"))


def finish_runs(runs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Runs with the ends of ``done`` (id, status, error, papers_new): a null error or count leaves the old one, a null status is completed."""
    ends = done.select("id", F.struct(F.coalesce("status", F.lit("completed")).alias("status"), "error", "papers_new").alias("__e"))
    joined = runs.join(ends, "id", "left")
    hit = F.col("__e").isNotNull()
    new = {"status": F.when(hit, F.col("__e.status")).otherwise(F.col("status")), "finished_at": F.when(hit, now).otherwise(F.col("finished_at")), "error": F.coalesce("__e.error", "error"), "papers_new": F.coalesce("__e.papers_new", "papers_new")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in runs.columns])


def run_totals(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with their tokens and cost raised by the events' sums: the roll-up of one batch of events."""
    sums = rollup(events, ["run_id"], {f"__{c}": c for c in ("input_tokens", "output_tokens", "cached_input_tokens", "cost_cents")})
    joined = runs.join(sums, F.col("id") == F.col("run_id"), "left")
    added = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
    return joined.select(*[added(c) if f"__{c}" in sums.columns else F.col(c) for c in runs.columns])


def run_cost(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id) with cost_cents so far; 0 for an unknown run."""
    return asked.select("id").join(runs.select("id", "cost_cents"), "id", "left").select("id", F.coalesce("cost_cents", F.lit(0.0)).alias("cost_cents"))


def spend_by(events: DataFrame, runs: DataFrame | None, dims: list[str], amount: str, since: Column | None = None, ts: str = "occurred_at") -> DataFrame:
    """dims, spend and n of events (joined with ``runs`` on run_id = id where a dimension is a run's), greatest spend first."""
    rows = events if since is None else events.where(F.col(ts) >= since)
    if runs is not None:
        rows = rows.join(runs, F.col("run_id") == F.col("id"))
    return rows.groupBy(*dims).agg(F.sum(amount).alias("spend"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("spend"), *dims)


def check_budget(events: DataFrame, policies: DataFrame, now: Column, ts: str = "occurred_at", amount: str = "cost_cents") -> DataFrame:
    """One row: ok, observed, cap, warn, tripped, utilization by the policy of id 1; without a policy everything is ok and the cap 0."""
    seen = month_to_date(events, now, ts, amount)
    # at most one policy has id 1
    policy = policies.where("id = 1").agg(F.max("cap_cents").alias("cap"), F.max("warn_pct").alias("pct"), F.max("hard_stop").alias("stop"))
    both = seen.crossJoin(policy).withColumn("warn", F.ceil(F.col("cap") * F.col("pct") / 100).cast("long"))
    tripped = F.when(F.col("observed") >= F.col("cap"), "hard_stop").when(F.col("observed") >= F.col("warn"), "warning")
    both = both.withColumn("tripped", tripped)
    ok = ~((F.coalesce("tripped", F.lit("")) == "hard_stop") & F.coalesce("stop", F.lit(False)))
    return both.select(ok.alias("ok"), "observed", F.coalesce("cap", F.lit(0)).cast("long").alias("cap"), F.coalesce("warn", F.lit(0)).cast("long").alias("warn"), "tripped", F.coalesce(F.try_divide(F.col("observed").cast("double"), F.col("cap").cast("double")), F.lit(0.0)).alias("utilization"))


def open_now(incidents: DataFrame) -> DataFrame:
    """Open incidents, oldest first."""
    return incidents.where("status = 'open'").select("id", "threshold", "observed_cents", "opened_at").orderBy("id")


def last_runs(runs: DataFrame, most: int, order: str = "started_at", tie: str = "id") -> DataFrame:
    """The latest ``most`` runs."""
    return runs.orderBy(F.desc(order), F.desc(tie)).limit(most)


def stats_of(stats: DataFrame, routine: str) -> DataFrame:
    """A routine's source statistics by source, with the keep rate (0 without papers)."""
    rate = F.coalesce(F.try_divide(F.col("kept").cast("double"), F.col("seen").cast("double")), F.lit(0.0))
    return stats.where(F.col("routine") == routine).select("source", "kept", "seen", "muted", rate.alias("rate")).orderBy("source")
