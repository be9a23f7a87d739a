"""Budgets and routines as keyed state against plain folds, over restarts and repeated batches."""

import datetime as dt

import pytest

from lumenloom.operators import schedule
from lumenloom.streaming import state
from lumenloom.streaming.state import Routine

EVENTS = "event_id string, budget string, cents double, occurred_at timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.stateful(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def put(spark, folder, rows, shape=EVENTS):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").json(str(folder))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination(180)
    finally:
        query.stop()


def at(text):
    return dt.datetime.fromisoformat(text)


def test_a_stream_stops_at_its_cap_and_goes_on_next_month(spark, tmp_path):
    policies = spark.createDataFrame([("a", 100, 75), ("b", 1000, 80)], "budget string, cap_cents long, warn_pct long")
    today = tmp_path / "today"

    def go(day):
        today.write_text(day)
        stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
        levels = state.month_budgets(stream, policies)
        run(state.stop_at_cap(levels, str(tmp_path / "out"), lambda: at(today.read_text())))

    def found():
        rows = spark.read.schema(state.BUDGET).parquet(str(tmp_path / "out/levels/batch=*")).collect()
        return sorted((r.budget, r.month.strftime("%m"), r.event, r.observed) for r in rows)

    put(spark, tmp_path / "in", [("1", "a", 70.0, at("2024-03-02")), ("2", "b", 10.0, at("2024-03-02")), ("1", "a", 70.0, at("2024-03-02")), (None, "a", 999.0, at("2024-03-02")), ("9", "z", 1e9, at("2024-03-02"))])
    go("2024-03-03")
    assert found() == []
    put(spark, tmp_path / "in", [("1", "a", 70.0, at("2024-03-02")), ("3", "a", 5.0, at("2024-03-04"))])
    go("2024-03-05")
    assert found() == [("a", "03", "warning", 75.0)]  # 75 of 100, the repeated event counted once
    put(spark, tmp_path / "in", [("4", "a", 30.0, at("2024-03-06")), ("5", "a", 30.0, at("2024-03-07"))])
    for _ in range(2):  # the same month: it stops again, and nothing is counted twice
        with pytest.raises(Exception, match="at their cap in 2024-03: a"):
            go("2024-03-08")
        assert found() == [("a", "03", "hard_stop", 105.0), ("a", "03", "warning", 75.0)]
    put(spark, tmp_path / "in", [("6", "a", 20.0, at("2024-04-03"))])
    go("2024-04-03")
    go("2024-04-03")
    assert [x for x in found() if x[2] == "closed"] in ([], [("a", "03", "closed", 135.0), ("b", "03", "closed", 10.0)])
    put(spark, tmp_path / "in", [("7", "a", 60.0, at("2024-04-09"))])
    go("2024-04-09")
    go("2024-04-09")
    assert [x for x in found() if x[2] == "closed"] == [("a", "03", "closed", 135.0), ("b", "03", "closed", 10.0)]
    assert ("a", "04", "warning", 80.0) in found() and ("a", "04", "hard_stop", 80.0) not in found()


def plain_due(routines, times):
    """schedule.due's rule as a fold over times, with ticks by trying every minute."""
    def fires(cron, t):
        fields = (t.minute, t.hour, t.day, t.month, (t.weekday() + 1) % 7)
        return all(f == "*" or v in schedule.allowed(f, low, high, names) for v, f, (low, high, names) in zip(fields, cron.split(), schedule.FIELDS, strict=True))

    last, out = {}, []
    for now in times:
        for r in routines:
            minute = now.replace(second=0)
            recent = next((t for k in range(14 * 24 * 60 + 1) if fires(r.cron, t := minute - dt.timedelta(minutes=k))), None)
            action = "wait"
            if r.enabled and recent is not None:
                action = "start" if r.name not in last else "fire" if recent > last[r.name] else "wait"
            if action != "wait":
                last[r.name] = now
            out.append((r.name, now, recent, action))
    return sorted(out)


def test_routines_fire_as_the_rule_says_over_restarts(spark, tmp_path):
    routines = [Routine("daily", "30 6 * * *"), Routine("weekly", "0 8 * * mon"), Routine("off", "* * * * *", enabled=False), Routine("never", "0 0 31 2 *")]
    times = [at("2024-03-03 05:00"), at("2024-03-03 07:00"), at("2024-03-03 07:01"), at("2024-03-04 09:00:30"), at("2024-03-09 12:00"), at("2024-03-11 08:00"), at("2024-03-11 08:00:59"), at("2024-04-20 00:00")]
    for part in (times[:3], times[3:4], times[4:]):
        put(spark, tmp_path / "in", [(t,) for t in part], "now timestamp")
        clock = spark.readStream.schema("now timestamp").json(str(tmp_path / "in"))
        run(state.fired(clock, routines).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = sorted((r.name, r.now, r.recent, r.action) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in plain_due(routines, times)]
    assert [r for *_, r in got if r == "fire"] and sum(x[3] == "fire" and x[0] == "daily" for x in got) == 5


def test_a_zone_moves_the_tick(spark, tmp_path):
    put(spark, tmp_path / "in", [(at("2024-07-01 04:00"),), (at("2024-07-01 04:31"),)], "now timestamp")
    clock = spark.readStream.schema("now timestamp").json(str(tmp_path / "in"))
    run(state.fired(clock, [Routine("berlin", "30 6 * * *", "Europe/Berlin")]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("now").collect()
    assert [r.action for r in got] == ["start", "fire"] and got[1].recent == at("2024-07-01 04:30")

