"""Literature connectors over saved responses (no network): arXiv Atom, Europe PMC and Semantic Scholar JSON.

Each returns paper records with one schema. The date filter keeps records without a date. Europe PMC's
query text (source, date and journals pushed down) is built by ``europe_pmc_query``. The same services as a
source with pushed-down filters, and as a stream, are in ``literature``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "title string, abstract string, doi string, arxiv_id string, pmid string, s2_id string, year int, journal string, source string, pdf_url string, published string"
_ATOM = "{http://www.w3.org/2005/Atom}"
_ARXIV = "{http://arxiv.org/schemas/atom}"


def year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def since(records: DataFrame, day: dt.date | None) -> DataFrame:
    """Records not before ``day``; those without a date stay."""
    return records if day is None else records.where(F.col("published").isNull() | (F.substring("published", 1, 10) >= F.lit(day.isoformat())))


def arxiv_query(query: str, categories: Sequence[str] = ()) -> str:
    return f"all:{query}" if not categories else f"all:{query} AND ({' OR '.join(f'cat:{c}' for c in categories)})"


def atom(xml: str) -> list[tuple]:
    """Records of an Atom feed in the order of RECORD; an unreadable feed gives none."""
    try:
        entries = ElementTree.fromstring(xml).findall(f"{_ATOM}entry")
    except ElementTree.ParseError:
        return []
    rows = []
    for e in entries:
        say = lambda tag, e=e: " ".join((e.findtext(tag) or "").split()) or None
        url = say(f"{_ATOM}id") or ""
        pdf = next((x.get("href") for x in e.findall(f"{_ATOM}link") if x.get("title") == "pdf"), None)
        published = say(f"{_ATOM}published")
        rows.append((say(f"{_ATOM}title"), say(f"{_ATOM}summary"), say(f"{_ARXIV}doi"), url.rsplit("/abs/", 1)[-1] or None, None, None, int(published[:4]) if published and published[:4].isdigit() else None, say(f"{_ARXIV}journal_ref"), "arxiv", pdf, published))
    return rows


def read_arxiv(spark: SparkSession, path: str, day: dt.date | None = None) -> DataFrame:
    """Records of saved Atom feeds, one file a response; an unreadable file gives none."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for pdf in batches:
            frame = pd.DataFrame([r for x in pdf["value"] for r in atom(x)], columns=names)
            yield frame.astype({"year": "Int32"})

    return since(spark.read.text(path, wholetext=True).mapInPandas(run, RECORD), day)


def europe_pmc_query(query: str, day: dt.date | None = None, preprint: bool = False, journals: Sequence[str] = ()) -> str:
    """The search expression with all that the service can filter itself."""
    parts = [f"({query})", "SRC:PPR" if preprint else "SRC:MED"]
    if day:
        parts.append(f"FIRST_PDATE:[{day.isoformat()} TO 3000-01-01]")
    if journals and not preprint:
        parts.append("(" + " OR ".join(f'JOURNAL:"{j}"' for j in journals) + ")")
    return " AND ".join(parts)


def read_europe_pmc(spark: SparkSession, path: str, preprint: bool = False) -> DataFrame:
    item = "title string, abstractText string, doi string, pmid string, pubYear string, firstPublicationDate string, journalTitle string, journalInfo struct<journal:struct<title:string>>"
    raw = spark.read.schema(f"resultList struct<result:array<struct<{', '.join(x.replace(' ', ':', 1) for x in item.split(', '))}>>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    r = raw.select(F.explode("resultList.result").alias("r")).select("r.*")
    return r.select(
        "title", F.col("abstractText").alias("abstract"), "doi", F.lit(None).cast("string").alias("arxiv_id"), "pmid", F.lit(None).cast("string").alias("s2_id"), F.coalesce(F.col("pubYear").try_cast("int"), year(F.col("firstPublicationDate"))).alias("year"),
        F.coalesce("journalTitle", "journalInfo.journal.title").alias("journal"), F.lit("biorxiv" if preprint else "pubmed").alias("source"), F.lit(None).cast("string").alias("pdf_url"), F.col("firstPublicationDate").alias("published"),
    )


def read_semantic_scholar(spark: SparkSession, path: str, day: dt.date | None = None) -> DataFrame:
    raw = spark.read.schema("data array<struct<paperId:string,title:string,abstract:string,year:int,venue:string,publicationDate:string,externalIds:struct<DOI:string,ArXiv:string,PubMed:string>,openAccessPdf:struct<url:string>>>").option("multiLine", True).json(path)
    r = raw.select(F.explode("data").alias("r")).select("r.*")
    records = r.select(
        "title", "abstract", F.col("externalIds.DOI").alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("externalIds.PubMed").alias("pmid"), F.col("paperId").alias("s2_id"), F.coalesce("year", year(F.col("publicationDate"))).alias("year"),
        F.col("venue").alias("journal"), F.lit("semantic_scholar").alias("source"), F.col("openAccessPdf.url").alias("pdf_url"), F.col("publicationDate").alias("published"),
    )
    return since(records, day)


def pdf_urls(doi: Column, arxiv: Column, pdf_url: Column) -> Column:
    """Candidate addresses of an open PDF, in order, each once."""
    arxiv_pdf = F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)
    preprint = F.when(doi.startswith("10.1101/"), F.concat(F.lit("https://www.biorxiv.org/content/"), doi, F.lit("v1.full.pdf")))
    return F.array_distinct(F.array_compact(F.array(F.nullif(pdf_url, F.lit("")), arxiv_pdf, preprint)))


def is_pdf(content: Column) -> Column:
    """Magic bytes of a PDF."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
