"""Model calls by tasks: answers with their usage, retries with the wait that a service asks for, and a bill without doubles.

A call is known by its run and row. What a task was answered is written before anything is billed, and the
ledger takes each call once, so a task that runs again, or a batch, is billed for what it needed and no more.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.operators import ledger

USAGE = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_tokens", "latency_ms")
ANSWER = "text string, model string, " + ", ".join(f"{u} long" for u in USAGE) + ", attempts int, error string"
# Seconds that a wait is held between, and what each attempt waits where the service says nothing.
LEAST_WAIT, MOST_WAIT, STEP_WAIT = 2.0, 65.0, 15.0


@dataclass(frozen=True)
class Answer:
    """What a model said, and what it used. ``input_tokens`` does not hold cached ones where ``split`` has been applied."""

    text: str
    model: str
    input_tokens: int = 0
    output_tokens: int = 0
    cached_input_tokens: int = 0
    cache_creation_tokens: int = 0
    latency_ms: int = 0


@dataclass
class Busy(Exception):
    """The service asks to come back later."""

    headers: Mapping[str, str] = field(default_factory=dict)


Model = Callable[[str], Answer]


def asked_wait(headers: Mapping[str, str]) -> float | None:
    """Seconds that an answer's headers ask to wait: ``Retry-After``, else a reset like ``1m30.5s`` or ``250ms``; None if they do not say."""
    held = {k.lower(): v for k, v in headers.items()}
    if re.fullmatch(r"\d+(\.\d*)?|\.\d+", held.get("retry-after", "")):
        return float(held["retry-after"])
    for name in ("x-ratelimit-reset-tokens", "x-ratelimit-reset-requests"):
        if value := held.get(name):
            found = re.fullmatch(r"(?:(?P<m>\d+)m(?!s))?(?:(?P<s>\d+(?:\.\d+)?)s)?(?:(?P<ms>\d+)ms)?", value.strip())
            if not found:
                return None
            return 60 * int(found["m"] or 0) + float(found["s"] or 0) + int(found["ms"] or 0) / 1000
    return None


def split_usage(prompt_tokens: int, cached: int = 0, creation: int = 0) -> int:
    """Input tokens that are billed in full, where a service counts cached ones in; never under 0."""
    return max(prompt_tokens - cached - creation, 0)


def ask(model: Model, prompt: str, attempts: int, sleep: Callable[[float], None]) -> tuple[Answer | None, int, str | None]:
    """Answer, attempts, error. Only ``Busy`` is tried again; what else goes wrong is the row's error."""
    for k in range(1, attempts + 1):
        try:
            return model(prompt), k, None
        except Busy as e:
            if k == attempts:
                return None, k, "Busy"
            wait = asked_wait(e.headers)
            sleep(min(max(STEP_WAIT * k if wait is None else wait, LEAST_WAIT), MOST_WAIT))
        except Exception as e:  # noqa: BLE001  one row's failure is not the others'
            return None, k, f"{type(e).__name__}: {e}"
    return None, 0, "no attempt"


def call(rows: DataFrame, prompt: str, build: Callable[[], Model], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` (any columns) with ``answer``: text, model, usage, attempts and error of the model's answer to ``prompt``.

    ``build`` makes the model, once a task. A null prompt is not sent, and its answer is null. Arrow batches
    stream through, so a task holds a batch of answers and no more. An input column called ``answer`` is replaced.
    """
    kept = [c for c in rows.columns if c != "answer"]
    kind = pa.struct([("text", pa.string()), ("model", pa.string()), *[(u, pa.int64()) for u in USAGE], ("attempts", pa.int32()), ("error", pa.string())])
    struct = ", ".join(x.replace(" ", ":", 1) for x in ANSWER.split(", "))

    def said(x: str | None, model: Model) -> dict | None:
        if x is None:
            return None
        answer, n, error = ask(model, x, attempts, sleep)
        usage = {u: getattr(answer, u) if answer else 0 for u in USAGE}
        return {"text": answer and answer.text, "model": answer and answer.model, **usage, "attempts": n, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or build()
            answers = [said(x, model) for x in batch.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(answers, kind)], names=[*kept, "answer"])

    shape = rows.select(*[f"`{c}`" for c in kept]).schema.simpleString().removeprefix("struct<").removesuffix(">")
    quoted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in kept]).schema) if shape else ""
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{quoted}, answer struct<{struct}>")


def answered(rows: DataFrame, key: list[str], prompt: str, build: Callable[[], Model], folder: str, **how) -> DataFrame:
    """Answers of ``rows`` from ``folder``, after those without one are asked and their answers appended.

    A row that failed is asked again the next time; one that was answered never is. Where a key was answered
    more than once (a batch that ran again), the first answer by (attempts, text) counts, always the same one.
    """
    spark = rows.sparkSession
    done = _held(spark, folder)
    fresh = rows if done is None else rows.join(done.where("answer.error IS NULL").select(*key).distinct(), key, "left_anti")
    call(fresh, prompt, build, **how).write.mode("append").parquet(folder)
    held = spark.read.parquet(folder)
    order = Window.partitionBy(*key).orderBy(F.col("answer.error").isNotNull(), "answer.attempts", "answer.text")
    once = held.withColumn("__first", F.row_number().over(order)).where(F.col("__first") == 1).drop("__first")
    return once.join(rows.select(*key).distinct(), key, "left_semi")


def _held(spark, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def usage_events(answers: DataFrame, run: str, row: str, phase: str | None = None, role: str | None = None) -> DataFrame:
    """Cost events of answers, one a call: event_id from run and row, model, phase, role and tokens. Rows without an answer used nothing."""
    identity = F.sha2(F.concat_ws("\x1f", F.col(run).cast("string"), F.col(row).cast("string"), F.lit(phase or "")), 256)
    tokens = [F.col(f"answer.{u}").alias(u) for u in USAGE if u != "latency_ms"]
    return answers.where("answer IS NOT NULL AND answer.error IS NULL").select(identity.alias("event_id"), F.col(run).alias("run_id"), F.col("answer.model").alias("model"), F.lit(phase).cast("string").alias("phase"), F.lit(role).cast("string").alias("role"), *tokens, F.lit(None).cast("double").alias("total_cost_usd"))


def bill(events: DataFrame, pricing: DataFrame, folder: str) -> DataFrame:
    """Append to the ledger under ``folder`` those priced ``events`` whose event_id it does not hold; the ledger.

    An event that comes twice in one call counts once. Unknown models cost nothing.
    """
    spark = events.sparkSession
    done = _held(spark, folder)
    rest = [c for c in events.columns if c != "event_id"]
    once = events.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("x")).select("event_id", "x.*")
    fresh = once if done is None else once.join(done.select("event_id"), "event_id", "left_anti")
    ledger.priced(fresh, pricing).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
