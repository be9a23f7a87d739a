"""Entity resolution: records that share any identifier, merged in arrival order.

Records interact only through shared identifiers, so they are first split into connected components
(distributed, over hashed identifiers), and the order-dependent merge is replayed inside each. Conflicting
identifiers leave several papers in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.runtime import BROADCAST_ROWS, materialize, workers_ready

#: Identifier columns, strongest first, with their prefix in a paper id.
IDS = (("doi", "doi:"), ("arxiv_id", "arxiv:"), ("pmid", "pmid:"), ("s2_id", "s2:"))
FIELDS = ("title", "abstract", "year", "journal")


def connected(edges: DataFrame) -> DataFrame:
    """node, root for ``edges`` (a, b: one orderable type): root is the least node reachable.

    Star contraction: every round links all neighbours of a node to the least of them, first the larger
    ones, then the smaller ones; a round is written to the shared folder, and equal rounds end the loop.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    of = lambda table: table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = of(edges)
    while True:
        both = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        # a hub's rows stay where they are where the table of least neighbours is short; else both sides are shuffled, which can be split
        short = lambda table, name: F.broadcast(table) if 2 * last[0] <= BROADCAST_ROWS else materialize(table, name)
        least = short(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = short(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct(), "stars")
        now = of(edges)
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now


def components(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """row, component (least row id) of rows that share a value of any key column, transitively; null shares nothing."""
    held = rows.select(row, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).where("x.value IS NOT NULL").select(row, "x.key", "x.value")
    # a star from each value's least row: no pair of rows is formed
    least = held.groupBy("key", "value").agg(F.min(row).alias("b"))
    edges = held.join(least, ["key", "value"]).select(F.col(row).alias("a"), "b").where("a <> b")
    roots = connected(edges).withColumnRenamed("node", row)
    return rows.select(row).distinct().join(roots, row, "left").select(row, F.coalesce("root", row).alias("component"))


_COLUMNS = [c for c, _ in IDS] + list(FIELDS)
PAPER = "paper_id string, doi string, arxiv_id string, pmid string, s2_id string, title string, abstract string, year int, journal string, sources array<string>, first_seq long"


def replay(held: list[dict], records: list[dict]) -> list[dict]:
    """Papers after ``records``, in their order, have come to the papers ``held``.

    What a paper's identifiers lead to is all the state there is: of_id holds those of the papers at hand.
    """
    papers = {p["paper_id"]: p for p in held}
    of_id = {(c, p[c]): p["paper_id"] for p in held for c, _ in IDS if p[c]}

    def absorb(into: dict, other: dict) -> None:
        for c in _COLUMNS:
            into[c] = into[c] or other[c]
        into["sources"] |= other["sources"]

    for record in records:
        found = list(dict.fromkeys(of_id[c, record[c]] for c, _ in IDS if record[c] and (c, record[c]) in of_id))
        if found:
            paper = papers[found[0]]
            for name in found[1:]:
                loser = papers.pop(name)
                for c, _ in IDS:  # an identifier that the survivor has otherwise is lost, and may start a paper again
                    of_id.pop((c, loser[c]), None)
                absorb(paper, loser)
        else:
            name = next((p + record[c] for c, p in IDS if record[c]), None)
            if name is None:
                continue
            paper = papers[name] = dict.fromkeys(_COLUMNS) | {"paper_id": name, "sources": set(), "first_seq": record["seq"]}
        absorb(paper, record)
        of_id.update({(c, paper[c]): paper["paper_id"] for c, _ in IDS if paper[c]})
    return list(papers.values())


def _record(r: dict) -> dict:
    """A record, what is empty as None."""
    return {c: None if r[c] == "" else r[c] for c in _COLUMNS} | {"seq": r["seq"], "sources": {r["source"]} if r["source"] else set()}


def _paper(r: dict) -> dict:
    """A paper as it was written."""
    return {c: r[c] for c in _COLUMNS} | {"paper_id": r["paper_id"], "sources": set(r["sources"] or ()), "first_seq": r["first_seq"]}


#: Papers of an Arrow batch that is given back.
BATCH = 2_000


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Papers of rows that stand together by component, papers before records and these by arrival."""
    names = ["paper_id", *_COLUMNS, "sources", "first_seq"]
    kinds = {"year": pa.int32(), "sources": pa.list_(pa.string()), "first_seq": pa.int64()}
    give = lambda papers: pa.RecordBatch.from_arrays([pa.array([sorted(p[c]) if c == "sources" else p[c] for p in papers], kinds.get(c, pa.string())) for c in names], names=names)
    ready: list[dict] = []
    for _, group in groupby((r for batch in batches for r in batch.to_pylist()), key=itemgetter("component")):
        rows = list(group)
        ready += replay([_paper(r) for r in rows if r["seq"] is None], [_record(r) for r in rows if r["seq"] is not None])
        if len(ready) >= BATCH:
            yield give(ready)
            ready = []
    yield give(ready)


def replayed(records: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Papers after ``records`` (component; seq and what ``with_ids`` gives) have come to ``held`` (component; papers), component by component.

    Components are dealt to tasks by hash, and a task goes through its own in one pass, so that a component costs its rows.
    """
    workers_ready(records.sparkSession)
    new = records.select("component", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("paper_id"), *_COLUMNS, "source", F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("long").alias("first_seq"))
    if held is not None:
        old = held.select("component", F.lit(None).cast("long").alias("seq"), "paper_id", *_COLUMNS, F.lit(None).cast("string").alias("source"), "sources", "first_seq")
        new = old.unionByName(new)
    return new.repartition("component").sortWithinPartitions("component", F.col("seq").asc_nulls_first()).mapInArrow(_replayed, PAPER)


def with_ids(records: DataFrame) -> DataFrame:
    """Records (seq, identifiers, fields, source) with normalised identifiers."""
    ids = records.withColumns({"doi": text.norm_doi(F.col("doi")), "arxiv_id": text.norm_arxiv(F.col("arxiv_id")), "pmid": text.empty_to_null(F.trim("pmid")), "s2_id": text.empty_to_null(F.trim("s2_id"))})
    return ids.select("seq", *[c for c, _ in IDS], *FIELDS, "source")


def merge_papers(records: DataFrame) -> DataFrame:
    """Papers from records (seq, doi, arxiv_id, pmid, s2_id, title, abstract, year, journal, source).

    First non-empty value wins; the survivor of a bridge is the paper of the incoming record's strongest
    identifier; an identifier that is set is never overwritten; a record without identifiers gives no
    paper. Rows of one component must fit one task: a component is one work and its copies.
    """
    ids = with_ids(records)
    grouped = ids.join(components(ids, "seq", [c for c, _ in IDS]), "seq")
    return replayed(grouped)


def link_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The links to append: distinct new ones that do not exist."""
    return new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
