"""Model calls with failures, waits and repeated tasks: the ledger equals the distinct calls."""

import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenloom.operators import model_calls
from lumenloom.operators.model_calls import Answer, Busy

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

PRICING = "model string, input_cents_per_mtok double, output_cents_per_mtok double, cached_input_cents_per_mtok double"


class Fake:
    """Answers by the prompt's length; some prompts are busy at first, some fail always; every call leaves a file."""

    def __init__(self, folder, down=()):
        self.folder, self.down, self.tried = str(folder), down, {}

    def __call__(self, prompt):
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        self.tried[prompt] = n = self.tried.get(prompt, 0) + 1
        if any(x in prompt for x in self.down):
            raise ValueError("no")
        if zlib.crc32(prompt.encode()) % 3 == 0 and n < 3:
            raise Busy({"Retry-After": "0.5"})
        return Answer(prompt.upper(), "fake", 100 * len(prompt), 10, 7, 3, 1)


def prompts(spark, n=12):
    return spark.createDataFrame([("r1", k, None if k == 5 else f"prompt {k}", "clash") for k in range(n)], "run string, row long, prompt string, answer string")


def test_answers_retries_and_errors(spark, tmp_path):
    rows = model_calls.call(prompts(spark), "prompt", lambda: Fake(tmp_path / "calls", ("prompt 7",)), sleep=lambda s: None)
    got = {r.row: r.answer for r in rows.collect()}
    assert rows.columns == ["run", "row", "prompt", "answer"] and len(got) == 12 and got[5] is None
    assert got[7].error == "ValueError: no" and got[7].text is None and got[7].input_tokens == 0
    for k, a in got.items():
        if k not in (5, 7):
            assert (a.text, a.error, a.attempts) == (f"PROMPT {k}", None, 3 if zlib.crc32(f"prompt {k}".encode()) % 3 == 0 else 1)
    assert model_calls.call(prompts(spark).limit(0), "prompt", lambda: Fake(tmp_path / "none")).count() == 0


def test_waits_follow_the_headers():
    waits = []

    def busy(prompt):
        raise Busy([{"Retry-After": "0.1"}, {"x-ratelimit-reset-tokens": "1m30.5s"}, {}, {"RETRY-AFTER": "7"}][len(waits)])

    assert model_calls.ask(busy, "p", 4, waits.append) == (None, 4, "Busy") and waits == [2.0, 65.0, 45.0]
    said = [({"retry-after": "12"}, 12.0), ({"Retry-After": "soon", "x-ratelimit-reset-requests": "250ms"}, 0.25), ({"x-ratelimit-reset-tokens": "2m"}, 120.0), ({"x-ratelimit-reset-tokens": "?"}, None), ({}, None)]
    for headers, want in said:
        assert model_calls.asked_wait(headers) == want
    assert model_calls.split_usage(100, 30, 20) == 50 and model_calls.split_usage(10, 30) == 0


def test_a_repeated_run_is_billed_once(spark, tmp_path):
    pricing = spark.createDataFrame([("fake", 1000.0, 2000.0, 100.0)], PRICING)
    folder, book = str(tmp_path / "answers"), str(tmp_path / "ledger")
    how = {"sleep": lambda s: None}
    totals = []
    for down in (("prompt 7",), (), ()):
        answers = model_calls.answered(prompts(spark), ["run", "row"], "prompt", lambda down=down: Fake(tmp_path / f"calls{len(totals)}", down), folder, **how)
        held = model_calls.bill(model_calls.usage_events(answers, "run", "row", "triage"), pricing, book)
        totals.append((held.count(), held.agg(F.sum("cost_cents")).first()[0]))
    assert [n for n, _ in totals] == [10, 11, 11] and totals[1] == totals[2]  # the failed row is asked again, the others never are
    assert len(list((tmp_path / "calls1").iterdir())) == (3 if zlib.crc32(b"prompt 7") % 3 == 0 else 1) and not (tmp_path / "calls2").exists()
    # a batch that ran again has left every answer twice, and events come twice
    spark.read.parquet(folder).coalesce(1).write.mode("append").parquet(folder)
    answers = model_calls.answered(prompts(spark), ["run", "row"], "prompt", lambda: Fake(tmp_path / "calls3"), folder, **how)
    events = model_calls.usage_events(answers, "run", "row", "triage")
    assert answers.count() == 12 and model_calls.bill(events.unionByName(events), pricing, book).count() == 11
    want = sum((100 * len(f"prompt {k}") * 1000 + 3 * 1000 * 1.25 + 7 * 100 + 10 * 2000) / 1e6 for k in range(12) if k != 5)
    assert totals[1][1] == pytest.approx(want)
    other = model_calls.usage_events(answers, "run", "row", "mine")
    assert model_calls.bill(other, pricing.limit(0), book).where("phase = 'mine'").agg(F.sum("cost_cents"), F.count(F.lit(1))).first() == (0.0, 11)
