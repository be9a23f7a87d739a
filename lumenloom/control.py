"""Control plane of routines: last-fired state, locks and the tick that starts what is due. Small files, one process."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import schedule


def utc_now() -> str:
    """Now as an ISO second in UTC."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class State:
    """Last-fired times, one JSON file a routine; a file that cannot be read counts as none."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def get(self, routine: str) -> datetime | None:
        try:
            return datetime.fromisoformat(json.loads((self.folder / f"{routine}.json").read_text())["last_fired"])
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def set(self, routine: str, when: datetime) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{routine}.json").write_text(json.dumps({"last_fired": when.astimezone(timezone.utc).isoformat()}))


class Lock:
    """A routine's lock: ``held`` is False while another live process has it; a dead one's is taken over."""

    def __init__(self, folder: str | Path, routine: str):
        self.path, self.held = Path(folder) / f"{routine}.lock", False

    def _alive(self) -> bool:
        try:
            os.kill(int(self.path.read_text().strip() or 0) or -1, 0)
        except (OSError, ValueError) as e:
            return isinstance(e, PermissionError)
        return True

    def __enter__(self) -> Lock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        for _ in range(2):
            try:
                with self.path.open("x") as f:
                    f.write(str(os.getpid()))
                self.held = True
                return self
            except FileExistsError:
                if self._alive():
                    return self
                self.path.unlink(missing_ok=True)
        return self

    def __exit__(self, *_) -> None:
        if self.held:
            self.path.unlink(missing_ok=True)
            self.held = False


def due(spark: SparkSession, routines: list[dict], now: datetime, state: State) -> list[str]:
    """Names of routines (name, schedule, timezone, enabled) to start; first sight starts the clock only, a missed tick is made up once."""
    rows = [(r["name"], r["schedule"], r.get("timezone", "UTC"), bool(r.get("enabled", True)), state.get(r["name"])) for r in routines if r.get("schedule")]
    fired = []
    for name, expr, zone, enabled, last in rows:
        local = F.from_utc_timestamp(F.lit(now.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"), zone)
        recent = F.to_utc_timestamp(schedule.recent_tick(expr, local), zone)
        seen = None if last is None else last.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        one = spark.range(1).select(F.lit(name).alias("name"), recent.alias("recent"), F.lit(seen).cast("timestamp_ntz").alias("last_fired"), F.lit(enabled).alias("enabled"))
        action = schedule.due(one.withColumn("recent", F.col("recent").cast("timestamp_ntz")), F.lit(now.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")).first()["action"]
        if action in ("start", "fire"):
            state.set(name, now)
        if action == "fire":
            fired.append(name)
    return fired


def tick(spark: SparkSession, routines: list[dict], run: Callable[[dict], str], state: State, locks: str | Path, now: datetime | None = None) -> list[tuple[str, str]]:
    """Start what is due; a routine that is still running is passed over."""
    by, out = {r["name"]: r for r in routines}, []
    for name in due(spark, routines, now or datetime.now(timezone.utc), state):
        with Lock(locks, name) as lock:
            out.append((name, run(by[name]) if lock.held else "coalesced"))
    return out


def previous_digest(files: DataFrame, routine: str) -> DataFrame:
    """One row: since, the time in the name of a routine's last digest (``routine_YYYYMMDDTHHMMSSZ.md``), the epoch without one."""
    mine = files.where(F.col("file").rlike(rf"^{re.escape(routine)}_.*\.md$")).agg(F.max("file").alias("file"))
    stamp = F.try_to_timestamp(F.regexp_extract("file", r"_(\d{8}T\d{6})Z\.md$", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return mine.select(F.coalesce(stamp, F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("since"))
