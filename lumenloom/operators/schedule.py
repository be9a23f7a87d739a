"""Cron schedules: predicates over timestamps, most recent ticks, due routines with catch-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DAYS = {d: k for k, d in enumerate("sun mon tue wed thu fri sat".split())}
FIELDS = ((0, 59, {}), (0, 23, {}), (1, 31, {}), (1, 12, _MONTHS), (0, 6, _DAYS))


def allowed(field: str, low: int, high: int, names: dict[str, int]) -> list[int]:
    """Values of one cron field: ``*``, lists, ranges, steps and names; ranges do not wrap, ``5/15`` is 5 alone."""
    number = lambda x: names.get(x.lower()) if x.lower() in names else int(x)
    found: set[int] = set()
    for part in field.split(","):
        span, _, step = part.strip().partition("/")
        if span in ("*", ""):
            first, last = low, high
        elif "-" in span:
            first, last = map(number, span.split("-"))
        else:
            first = last = number(span)
        found.update(range(first, last + 1, int(step or 1)))
    return sorted(x for x in found if low <= x <= high)


def matches(expr: str, ts: Column) -> Column:
    """Whether a minute fires: all five fields agree, day of month and day of week alike; Sunday is 0."""
    parts = expr.split()
    if len(parts) != 5:
        raise ValueError(f"a cron expression has 5 fields: {expr!r}")
    values = (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1)
    found = F.lit(True)
    for value, field, (low, high, names) in zip(values, parts, FIELDS, strict=True):
        if field != "*":
            found = found & value.isin(*allowed(field, low, high, names))
    return found


def recent_tick(expr: str, now: Column, days: int = 14) -> Column:
    """The latest firing minute at or before ``now`` within ``days``; null if none."""
    end = F.date_trunc("minute", now)
    minutes = F.sequence(end - F.expr(f"INTERVAL {days} DAYS"), end, F.expr("INTERVAL 1 MINUTE"))
    return F.array_max(F.filter(minutes, lambda t: matches(expr, t)))


def due(routines: DataFrame, now: Column) -> DataFrame:
    """Routines (name, recent, last_fired, enabled) with action: ``start`` (first sight, no run), ``fire`` or ``wait``.

    ``recent`` is the routine's latest tick as UTC. At most one missed tick is made up, as last_fired moves to now.
    """
    action = (
        F.when(~F.col("enabled") | F.col("recent").isNull(), "wait").when(F.col("last_fired").isNull(), "start").when(F.col("recent") > F.col("last_fired"), "fire").otherwise("wait")
    )
    return routines.withColumn("action", action).withColumn("last_fired", F.when(F.col("action").isin("start", "fire"), now).otherwise(F.col("last_fired")))
