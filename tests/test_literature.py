"""The literature source against a full read with filters, its requests, and the acquisition stream with failures and restarts."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenloom.sources import literature
from lumenloom.sources.literature import Replay, Request

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

DAYS = [f"2024-03-{d:02d}" for d in range(1, 25)]


def save(folder, source, day, records):
    path = folder / f"source={source}" / f"day={day}"
    path.mkdir(parents=True, exist_ok=True)
    (path / "part-0.json").write_text("".join(json.dumps(r) + "\n" for r in records))


@pytest.fixture
def saved(tmp_path):
    for k, day in enumerate(DAYS):
        save(tmp_path / "saved", "europepmc", day, [{"title": f"e{k}.{j}", "pmid": str(100 * k + j), "journalTitle": "ABC"[j % 3], "firstPublicationDate": day, "pubYear": day[:4]} for j in range(k % 7)])
        save(tmp_path / "saved", "europepmc_ppr", day, [{"title": f"p{k}", "doi": f"10.1101/{k}", "firstPublicationDate": day}])
        save(tmp_path / "saved", "semantic_scholar", day, [{"paperId": f"s{k}", "title": f"s{k}", "venue": "A", "publicationDate": None if k % 5 == 0 else day, "externalIds": {"PubMed": 100 * k}}])
    return str(tmp_path / "saved")


class Noted:
    """A transport that also writes each request it got to a folder."""

    def __init__(self, folder, inner, down=None):
        self.folder, self.inner, self.down = str(folder), inner, down

    def __call__(self, request: Request) -> str:
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([request.source, request.since, request.until, list(request.journals), request.parameters()], f)
        if self.down and os.path.exists(self.down):
            with open(self.down) as f:
                if request.source in f.read().split():
                    raise ConnectionError("503")
        return self.inner(request)


def noted(folder):
    return sorted((json.loads(p.read_text()) for p in folder.iterdir()), key=repr) if folder.exists() else []


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SOME = "europepmc,europepmc_ppr,semantic_scholar"


def read(spark, name, **options):
    reader = spark.read.format(name).option("queries", "q").option("sources", SOME)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_filters_reach_the_requests(spark, saved, tmp_path):
    name = literature.register(spark, Noted(tmp_path / "asked", Replay(saved)), "noted")
    full = rows(read(spark, name))
    assert len(full) == sum(k % 7 for k in range(24)) + 48
    for condition in ("published >= '2024-03-10' AND journal IN ('A', 'B') AND source = 'europepmc'", "published BETWEEN '2024-03-02' AND '2024-03-05'", "source IN ('semantic_scholar', 'other') AND published > '2024-03-20'", "journal = 'C' OR published IS NULL", "year = 2024 AND title LIKE 'p1%'", "published > '2024-03-09' AND published < '2024-03-02'"):
        got = read(spark, name, span_days="4").where(condition)
        want = spark.createDataFrame(full, got.schema).where(condition)
        assert rows(got) == rows(want), condition
    name = literature.register(spark, Noted(tmp_path / "one", Replay(saved)), "one")
    got = read(spark, name, span_days="4", until="2024-03-16").where("published >= '2024-03-10' AND journal IN ('A', 'B') AND source = 'europepmc'")
    plan = got._jdf.queryExecution().toString()
    assert got.count() == sum(sum(j % 3 < 2 for j in range(k % 7)) for k in range(9, 16)) and "one" in plan
    asked = noted(tmp_path / "one")
    assert [(a, b, c) for a, b, c, _, _ in asked] == [("europepmc", "2024-03-10", "2024-03-13"), ("europepmc", "2024-03-14", "2024-03-16")]
    assert all(j == ["A", "B"] for _, _, _, j, _ in asked)
    assert asked[0][4]["query"] == '(q) AND SRC:MED AND FIRST_PDATE:[2024-03-10 TO 2024-03-13] AND (JOURNAL:"A" OR JOURNAL:"B")'


def test_a_source_that_the_filter_leaves_out_is_not_asked(spark, saved, tmp_path):
    name = literature.register(spark, Noted(tmp_path / "asked", Replay(saved)), "left_out")
    assert read(spark, name).where("source = 'europepmc_ppr'").count() == 24
    assert {a for a, *_ in noted(tmp_path / "asked")} == {"europepmc_ppr"}
    assert read(spark, name).where("source = 'nature'").count() == 0


def test_fields_follow_the_schema(spark, saved, tmp_path):
    name = literature.register(spark, Noted(tmp_path / "asked", Replay(saved)), "narrow")
    got = spark.read.format(name).schema("title string, pmid string").option("queries", "q\nr").option("sources", "semantic_scholar").load()
    assert got.count() == 48 and got.first().pmid is not None
    assert {p["fields"] for *_, p in noted(tmp_path / "asked")} == {"title,externalIds"}


def test_pages_and_limits(spark, tmp_path):
    save(tmp_path / "s", "europepmc", "2024-01-01", [{"title": str(k), "pmid": str(k)} for k in range(250)])
    save(tmp_path / "s", "semantic_scholar", "2024-01-01", [{"paperId": str(k)} for k in range(200)])
    name = literature.register(spark, Noted(tmp_path / "asked", Replay(str(tmp_path / "s"))), "pages")
    assert read(spark, name).groupBy("source").count().orderBy("source").collect() == [("europepmc", 250), ("semantic_scholar", 200)]
    assert len(noted(tmp_path / "asked")) == 3 + 1 + 3  # the last full page of a service without a mark is followed by an empty one
    assert read(spark, name, limit="120").count() == 240


def test_arxiv_and_parameters():
    ask = Request("arxiv", "t cells", cursor="100").parameters()
    assert ask["search_query"] == "all:t cells" and ask["start"] == "100"
    assert Request("europepmc_ppr", "q", None, "2024-01-02", ("A",)).parameters()["query"] == "(q) AND SRC:PPR AND FIRST_PDATE:[1000-01-01 TO 2024-01-02]"
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.1v2</id><title>a</title></entry></feed>'
    assert [r["arxiv_id"] for r in literature.ask(lambda r: feed, Request("arxiv", "q"))] == ["2401.1v2"]
    assert list(literature.ask(lambda r: "{}", Request("europepmc", "q"))) == [] and list(literature.ask(lambda r: '{"data": null}', Request("semantic_scholar", "q"))) == []


def test_errors_fail_or_are_rows(spark, saved, tmp_path):
    (tmp_path / "down").write_text("europepmc_ppr")
    name = literature.register(spark, Noted(tmp_path / "asked", Replay(saved), str(tmp_path / "down")), "flaky")
    with pytest.raises(Exception, match="503"):
        read(spark, name).collect()
    got = read(spark, name, errors="rows")
    assert got.where("error IS NOT NULL").select("source", "error").collect() == [("europepmc_ppr", "ConnectionError: 503")]
    assert got.where("error IS NULL").count() == sum(k % 7 for k in range(24)) + 24
    with pytest.raises(Exception, match="unknown sources"):
        spark.read.format(name).option("sources", "nature").option("queries", "q").load().collect()


def test_spans():
    assert literature.spans("2024-02-27", "2024-03-02", 2) == [("2024-02-27", "2024-02-28"), ("2024-02-29", "2024-03-01"), ("2024-03-02", "2024-03-02")]
    assert literature.spans(None, "2024-03-02", 2) == [(None, "2024-03-02")] and literature.spans("2024-03-02", "2024-03-02", 0) == [("2024-03-02", "2024-03-02")]


class Clock:
    """The day that a file says."""

    def __init__(self, file):
        self.file = str(file)

    def __call__(self):
        with open(self.file) as f:
            return f.read()


def test_stream_with_a_failing_source_and_restarts(spark, saved, tmp_path):
    """One source is down for two of four runs; each run is a new query on the same checkpoint."""
    clock, down, folder = tmp_path / "day", tmp_path / "down", str(tmp_path / "acquired")
    name = literature.register(spark, Noted(tmp_path / "asked", Replay(saved), str(down)), "acquisition", Clock(clock))

    def run(day, broken):
        clock.write_text(day)
        down.write_text(broken)
        stream = spark.readStream.format(name).option("queries", "q").option("sources", SOME).option("since", "2024-03-01").option("errors", "rows").option("failed", f"{folder}/failed").load()
        query = literature.acquire(stream, folder).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        return literature.written(spark, f"{folder}/papers").count()

    first = run("2024-03-05", "europepmc_ppr")
    assert literature.read_failed(f"{folder}/failed")[0] == [["europepmc_ppr", "q", "2024-03-01", "2024-03-05"]]
    second = run("2024-03-12", "europepmc_ppr")
    assert second > first and len(literature.read_failed(f"{folder}/failed")[0]) == 2
    third = run("2024-03-12", "")  # no new day: only what failed is asked again
    assert third == second + 12 and literature.read_failed(f"{folder}/failed")[0] == []
    run("2024-03-24", "")
    assert run("2024-03-24", "") == run("2024-03-24", "")  # nothing is left to ask
    everything = read(spark, name)
    want = {r.paper_id for r in literature.new_records(everything, None).select("paper_id").collect()}
    got = [r.paper_id for r in literature.written(spark, f"{folder}/papers").select("paper_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = literature.written(spark, f"{folder}/counts").groupBy("source").agg(F.sum("failed").alias("f")).collect()
    assert {r.source: r.f for r in counts} == {"europepmc": 0, "europepmc_ppr": 3, "semantic_scholar": 0}


def test_new_records_take_each_paper_once(spark):
    shape = literature.RECORD
    one = ("t", None, "HTTPS://doi.org/10.1/A", None, None, None, 2024, None, "b", None, "2024-01-02")
    two = ("t", None, "10.1/a", None, "7", None, 2024, None, "a", None, None)
    none = ("no id", None, None, " ", "", None, None, None, "a", None, None)
    got = literature.new_records(spark.createDataFrame([one, two, one, none], shape), None).collect()
    assert [(r.paper_id, r.source) for r in got] == [("doi:10.1/a", "a")]
    assert literature.new_records(spark.createDataFrame([one], shape), spark.createDataFrame([("doi:10.1/a",)], "paper_id string")).count() == 0


def test_a_page_of_saved_days_reads_its_own_records(tmp_path):
    import json

    for day, n in (("2024-03-01", 130), ("2024-03-02", 170)):
        folder = tmp_path / "source=europepmc" / f"day={day}"
        folder.mkdir(parents=True)
        (folder / "part-0").write_text("".join(json.dumps({"pmid": f"{day}/{k}", "journalTitle": "AB"[k % 2]}) + "\n" for k in range(n)))
    replay, request = literature.Replay(str(tmp_path)), literature.Request("europepmc", "q", None, None, (), ())
    first = literature.parse(request, replay(request))
    second = literature.parse(request, replay(later := __import__("dataclasses").replace(request, cursor=first[1])))
    third = __import__("dataclasses").replace(request, cursor=second[1])
    (tmp_path / "source=europepmc" / "day=2024-03-01" / "part-0").unlink()  # the last page lies in the second day
    got = [r["pmid"] for r in [*first[0], *second[0], *literature.parse(third, replay(third))[0]]]
    assert got == [f"2024-03-01/{k}" for k in range(130)] + [f"2024-03-02/{k}" for k in range(170)] and later.cursor
    assert literature.parse(third, replay(third))[1] is None
