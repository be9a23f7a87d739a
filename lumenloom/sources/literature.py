"""Literature services as a Spark source: filters of a query shape the requests, and a task asks for one slice.

``register`` makes a format whose reader takes filters on ``source``, ``published`` and ``journal`` into its
requests, asks only for the fields of the schema, and plans one task for each query, source and span of days.
As a stream it remembers for each source the day up to which it has asked; a request that failed is a row
with an ``error``, and is asked again in the next batch, so that no source waits for another.

A transport is any picklable callable that answers a request with the service's text. ``Replay`` answers from
a folder of saved days; there is no network client here.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import itertools
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lumenloom.functions import text
from lumenloom.sources import connectors

RECORD = connectors.RECORD
#: What the request was, and why it has no answer.
ASKED = "query string, since string, until string, error string"
SOURCES = ("arxiv", "europepmc", "europepmc_ppr", "semantic_scholar")
#: Services that filter by day themselves; the others are asked once for all days.
BY_DAY = ("europepmc", "europepmc_ppr")
# The fields of Semantic Scholar that a column is read from.
S2_FIELDS = {"title": "title", "abstract": "abstract", "doi": "externalIds", "arxiv_id": "externalIds", "pmid": "externalIds", "s2_id": "paperId", "year": "year", "journal": "venue", "published": "publicationDate", "pdf_url": "openAccessPdf"}
PAGE = 100
#: Bytes that are read of a saved day at once.
READ = 1 << 15


@dataclass(frozen=True)
class Request:
    """One question to a service: days are ISO and inclusive, ``cursor`` is where the next page begins."""

    source: str
    query: str
    since: str | None = None
    until: str | None = None
    journals: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    cursor: str | None = None

    def parameters(self) -> dict[str, str]:
        """What the service is sent."""
        if self.source == "arxiv":
            return {"search_query": connectors.arxiv_query(self.query), "start": self.cursor or "0", "max_results": str(PAGE), "sortBy": "submittedDate", "sortOrder": "descending"}
        if self.source == "semantic_scholar":
            fields = dict.fromkeys(S2_FIELDS[c] for c in self.columns if c in S2_FIELDS)
            return {"query": self.query, "limit": str(PAGE), "offset": self.cursor or "0", "fields": ",".join(fields)}
        day = dt.date.fromisoformat(self.since) if self.since else None
        asked = connectors.europe_pmc_query(self.query, day, self.source == "europepmc_ppr", self.journals)
        if self.until:
            asked = asked.replace("3000-01-01", self.until) if day else f"{asked} AND FIRST_PDATE:[1000-01-01 TO {self.until}]"
        return {"query": asked, "format": "json", "pageSize": str(PAGE), "resultType": "core", "cursorMark": self.cursor or "*"}


Transport = Callable[[Request], str]


def parse(request: Request, answer: str) -> tuple[list[dict], str | None]:
    """Records of an answer by column, and the cursor of the next page; a page that is not full is the last."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    begin = int(request.cursor or 0) if (request.cursor or "0").isdigit() else 0
    if request.source == "arxiv":
        found = [dict(zip(names, row, strict=True)) for row in connectors.atom(answer)]
        return found, str(begin + len(found)) if len(found) == PAGE else None
    body = json.loads(answer)
    whole = lambda x: int(x) if str(x or "").isdigit() else None
    if request.source == "semantic_scholar":
        found = []
        for r in body.get("data") or []:
            ids = r.get("externalIds") or {}
            day = r.get("publicationDate")
            found.append({"title": r.get("title"), "abstract": r.get("abstract"), "doi": ids.get("DOI"), "arxiv_id": ids.get("ArXiv"), "pmid": None if ids.get("PubMed") is None else str(ids["PubMed"]), "s2_id": r.get("paperId"), "year": whole(r.get("year")) or whole((day or "")[:4]), "journal": r.get("venue") or None, "pdf_url": (r.get("openAccessPdf") or {}).get("url"), "published": day})
        return found, str(begin + len(found)) if len(found) == PAGE else None
    found = []
    for r in (body.get("resultList") or {}).get("result") or []:
        day = r.get("firstPublicationDate")
        journal = r.get("journalTitle") or ((r.get("journalInfo") or {}).get("journal") or {}).get("title")
        found.append({"title": r.get("title"), "abstract": r.get("abstractText"), "doi": r.get("doi"), "pmid": r.get("pmid"), "year": whole(r.get("pubYear")) or whole((day or "")[:4]), "journal": journal, "published": day})
    after = body.get("nextCursorMark")
    return found, after if found and after and after != request.cursor else None


def ask(transport: Transport, request: Request, most: int | None = None) -> Iterator[dict]:
    """Records of all pages, ``most`` at most (as many as the caller wants of a service, by its own order)."""
    while True:
        found, cursor = parse(request, transport(request))
        for r in found if most is None else found[:most]:
            yield r | {"source": request.source}
        most = None if most is None else most - len(found)
        if cursor is None or (most is not None and most <= 0):
            return
        request = dataclasses.replace(request, cursor=cursor)


@dataclass(frozen=True)
class Replay:
    """Answers from saved days: ``folder``/source=<source>/day=<day>/ holds texts of a JSON record in the service's form a line.

    Journals and days of the request are applied as the service would; the query is not read, as a folder
    holds the answers of one. Any store that Arrow can open will do.
    """

    folder: str

    def __call__(self, request: Request) -> str:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        if request.source == "semantic_scholar":  # its cursor is a number of records
            begin = int(request.cursor or 0)
            held = self._records(store, base, request, "", 0)
            return json.dumps({"data": [json.loads(line) for _, _, line in itertools.islice(held, begin, begin + PAGE)]})
        # the cursor is the place of a page's first record, so that a page reads its own records and no others
        file, _, at = (request.cursor if request.cursor not in (None, "*") else "").rpartition("@")
        page, more = [], {}
        for name, place, line in self._records(store, base, request, file, int(at or 0)):
            record = json.loads(line)
            if request.journals and request.source == "europepmc" and record.get("journalTitle") not in request.journals:
                continue
            if len(page) == PAGE:
                more = {"nextCursorMark": f"{name}@{place}"}
                break
            page.append(record)
        return json.dumps({"resultList": {"result": page}} | more)

    @staticmethod
    def _records(store, base: str, request: Request, file: str, at: int) -> Iterator[tuple[str, int, bytes]]:
        """Day and file, place in it and line of each record, in their order, from a place on."""
        from pyarrow import fs

        top = f"{base}/source={request.source}"
        days = [x for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.type == fs.FileType.Directory]
        named = {x.path.rsplit("day=", 1)[-1]: x.path for x in days}
        begun = file.partition("/")[0]
        for day in sorted(d for d in named if (not request.since or d >= request.since) and (not request.until or d <= request.until) and d >= begun):
            for x in sorted(store.get_file_info(fs.FileSelector(named[day])), key=lambda f: f.path):
                name = f"{day}/{x.base_name}"
                if x.type != fs.FileType.File or x.base_name.startswith(("_", ".")) or (day == begun and name < file):
                    continue
                place = at if name == file else 0
                with store.open_input_file(x.path) as held:
                    held.seek(place)
                    rest = b""
                    while block := held.read(READ):
                        *lines, rest = (rest + block).split(b"\n")
                        for line in lines:
                            if line.strip():
                                yield name, place, line
                            place += len(line) + 1
                    if rest.strip():
                        yield name, place, rest


def spans(since: str | None, until: str | None, days: int) -> list[tuple[str | None, str | None]]:
    """Consecutive spans of at most so many days; an open side is one span."""
    if not since or not until:
        return [(since, until)]
    first, last = dt.date.fromisoformat(since), dt.date.fromisoformat(until)
    starts = range(0, (last - first).days + 1, max(1, days))
    return [((first + dt.timedelta(k)).isoformat(), min(last, first + dt.timedelta(k + max(1, days) - 1)).isoformat()) for k in starts]


def _shift(day: str, days: int) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days)).isoformat()


class _Options:
    def __init__(self, options: dict[str, str], schema: T.StructType, transport: Transport):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.sources = [s for s in options.get("sources", ",".join(SOURCES)).split(",") if s]
        if unknown := set(self.sources) - set(SOURCES):
            raise ValueError(f"unknown sources: {sorted(unknown)}")
        self.journals = tuple(j for j in options.get("journals", "").split("\n") if j)
        self.since, self.until = options.get("since"), options.get("until")
        self.span = int(options.get("span_days", "30"))
        self.most = int(options["limit"]) if "limit" in options else None
        self.errors = options.get("errors", "fail")
        self.failed = options.get("failed")
        self.columns = tuple(schema.names)
        self.transport = transport

    def requests(self, sources: Sequence[str], since: str | None, until: str | None, journals: tuple[str, ...]) -> list[Request]:
        found = []
        for source in sources:
            for a, b in spans(since, until, self.span) if source in BY_DAY else [(since, until)]:
                found += [Request(source, q, a, b, journals if source == "europepmc" else (), self.columns) for q in self.queries]
        return found

    def rows(self, request: Request) -> Iterator[tuple]:
        asked = {"query": request.query, "since": request.since, "until": request.until}
        row = lambda r: tuple(r.get(c) for c in self.columns)
        if self.errors != "rows":
            for r in ask(self.transport, request, self.most):
                yield row(r | asked)
            return
        try:
            found = list(ask(self.transport, request, self.most))  # all pages or none: a request is asked again whole
        except Exception as e:  # noqa: BLE001  what a service does wrong is data here
            yield row(asked | {"source": request.source, "error": f"{type(e).__name__}: {e}"})
            return
        for r in found:
            yield row(r | asked)


class _Reader(DataSourceReader):
    """A batch: filters narrow sources, days and journals; those on days and journals are also applied by Spark."""

    def __init__(self, options: _Options):
        self.o = options
        self.sources, self.since, self.until = list(options.sources), options.since, options.until
        self.journals = options.journals

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if name == "source" and values is not None:
                self.sources = [s for s in self.sources if s in values]
                continue
            if name == "journal" and values is not None:
                kept = tuple(str(v) for v in values)
                self.journals = tuple(j for j in kept if j in self.journals) if self.journals else kept
            elif name == "published" and isinstance(getattr(f, "value", None), str) and len(f.value) >= 10:
                day = f.value[:10]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = max(self.since or day, day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = min(self.until or day, day)
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.since and self.until and self.since > self.until:
            return []
        return [InputPartition(r) for r in self.o.requests(self.sources, self.since, self.until, self.journals)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None:
            yield from self.o.rows(partition.value)


class _StreamReader(DataSourceStreamReader):
    """Offsets: the last day asked for by source, the requests that failed in the last batch, and that batch's number."""

    def __init__(self, options: _Options, today: Callable[[], str]):
        self.o, self.today = options, today

    def initialOffset(self) -> dict:
        return {"days": dict.fromkeys(self.o.sources, _shift(self.o.since or self.today(), -1)), "again": [], "batch": -1}

    def latestOffset(self) -> dict:
        again, batch = read_failed(self.o.failed) if self.o.failed else ([], -1)
        until = min(self.today(), self.o.until or self.today())
        return {"days": dict.fromkeys(self.o.sources, until), "again": again, "batch": batch if again else -1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for source in self.o.sources:
            # a source that is new to the stream begins where the stream began
            since = _shift(start["days"].get(source) or _shift(self.o.since or end["days"][source], -1), 1)
            if since <= end["days"][source]:
                found += self.o.requests([source], since, end["days"][source], self.o.journals)
        if end["batch"] != start["batch"]:
            found += [Request(s, q, a, b, self.o.journals if s == "europepmc" else (), self.o.columns) for s, q, a, b in end["again"]]
        return [InputPartition(r) for r in dict.fromkeys(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.o.rows(partition.value)

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch."""


def register(spark: SparkSession, transport: Transport, name: str = "literature", today: Callable[[], str] | None = None) -> str:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` ask through ``transport``.

    Options: ``queries`` and ``journals`` (one a line), ``sources`` (comma between), ``since``, ``until``, ``span_days``,
    ``limit`` (records of a query and source, by the service's order), ``errors`` (``fail`` or ``rows``), and for a
    stream ``failed``, the folder that ``acquire`` writes failed requests to. A narrower schema asks for less.
    """
    clock = today or (lambda: dt.datetime.now(dt.UTC).date().isoformat())

    class Literature(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{RECORD}, {ASKED}" if self.options.get("errors") == "rows" else RECORD

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(_Options(dict(self.options), schema, transport))

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _StreamReader(_Options(dict(self.options), schema, transport), clock)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Literature)
    return name


def read_failed(folder: str) -> tuple[list[list[str | None]], int]:
    """Requests (source, query, since, until) that failed in the last batch written to ``folder``, and its number."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    batches = [x.path for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory and "batch=" in x.base_name]
    done = [p for p in batches if store.get_file_info(f"{p}/_SUCCESS").type == fs.FileType.File]
    if not done:
        return [], -1
    last = max(done, key=lambda p: int(p.rsplit("batch=", 1)[-1]))
    rows = []
    for file in sorted(store.get_file_info(fs.FileSelector(last)), key=lambda f: f.path):
        if file.base_name.startswith("part-"):
            with store.open_input_stream(file.path) as lines:
                rows += [json.loads(x) for x in lines.read().decode().splitlines() if x]
    return sorted([[r.get(k) for k in ("source", "query", "since", "until")] for r in rows], key=repr), int(last.rsplit("batch=", 1)[-1])


def new_records(records: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Records with an identifier, each paper once (``paper_id``, by the strongest one), that ``earlier`` does not hold.

    Of several records of a paper in one batch the least (source, published, title) stays.
    """
    ids = (text.norm_doi(F.col("doi")), text.norm_arxiv(F.col("arxiv_id")), text.empty_to_null(F.trim("pmid")), text.empty_to_null(F.trim("s2_id")))
    known = records.withColumn("paper_id", text.canonical_id(*ids)).where("paper_id IS NOT NULL")
    rest = [c for c in known.columns if c != "paper_id"]
    once = known.groupBy("paper_id").agg(F.min_by(F.struct(*rest), F.struct(*[F.coalesce(c, F.lit("")) for c in ("source", "published", "title")])).alias("x")).select("paper_id", "x.*")
    return once if earlier is None else once.join(earlier.select("paper_id"), "paper_id", "left_anti")


def acquire(stream: DataFrame, folder: str):
    """A writer of an acquisition stream (``errors`` = ``rows``) under ``folder``: records, counts of each source, failed requests.

    A batch writes its own folder, over what an earlier attempt at it left, and links to what earlier batches
    hold; so a batch that runs again changes nothing. The failed requests come last: they start the next attempt.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = f"{folder}/answers/batch={number}"
        batch.write.mode("overwrite").parquet(held)
        answers = spark.read.schema(batch.schema).parquet(held)
        records = answers.where("error IS NULL").drop(*[c.split()[0] for c in ASKED.split(", ")])
        earlier = written(spark, f"{folder}/papers", number)
        new_records(records, earlier).write.mode("overwrite").parquet(f"{folder}/papers/batch={number}")
        counts = answers.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("records"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("error").alias("error"))
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        answers.where("error IS NOT NULL").select("source", "query", "since", "until", "error").coalesce(1).write.mode("overwrite").json(f"{folder}/failed/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")


def written(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The batches of a table under ``folder``, those before a number where one is given; None where there is none."""
    try:
        table = spark.read.option("basePath", folder).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return table if before is None else table.where(F.col("batch") < before)
