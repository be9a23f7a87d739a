"""Markdown and HTML regions: clauses, citations, appendix mapping, titles, JSON recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the synthesis format.
CITATION = r"\[([A-Z][^\[\]]*?)\]"
YEAR = r"\b(19|20)\d{2}\b"
FENCE = r"(?s)```.*?```"
TABLE_RULE = r"^[\s|:\-]+$"
SENTENCE_END = r"(?<=[.!?;:])\s+"
EVIDENCE_FILE = r"`([^`]*_evidence\.md)`"
APPENDIX_A = r"(?im)^##+\s*Appendix\s+A\b.*$"
ANY_APPENDIX = r"(?im)^##+\s*Appendix\s"
NEXT_SECTION = r"(?im)^##+\s+\S"
EXTERNAL_REVIEW = "[External Review]"


def without_code(body: Column) -> Column:
    """Fenced blocks become a space, except drawn trees (with a pointer or a rule of box lines)."""
    parts = F.split(F.regexp_replace(body, FENCE, "\x00$0\x00"), "\x00")
    drawn = lambda x: x.contains("►") | x.contains("──")
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("```") & x.endswith("```") & (F.length(x) >= 6) & ~drawn(x), " ").otherwise(x)), "")


def clauses(docs: DataFrame, key: str, body: str, sentence_end: str = SENTENCE_END) -> DataFrame:
    """key, line, pos, clause: prose lines by sentence, table rows whole (cells joined by a dot), rules dropped."""
    lines = docs.select(key, F.posexplode(F.split(without_code(F.col(body)), r"\r?\n")).alias("line", "raw")).withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    bars = F.length("raw") - F.length(F.replace("raw", F.lit("|"), F.lit("")))
    row = F.startswith("raw", F.lit("|")) | (bars >= 2)
    cells = F.filter(F.transform(F.split(F.regexp_replace("raw", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    whole = F.when(F.col("raw").rlike(TABLE_RULE) | (F.size(cells) == 0), F.array().cast("array<string>")).otherwise(F.array(F.array_join(cells, " · ")))
    found = F.when(row, whole).otherwise(F.filter(F.transform(F.split("raw", sentence_end), lambda x: F.trim(x)), lambda c: c != ""))
    return lines.where("raw <> ''").select(key, "line", F.posexplode(found).alias("pos", "clause"))


def citation_key(inner: Column) -> Column:
    """First surname, lower case, without year and et al."""
    bare = F.regexp_replace(F.regexp_replace(inner, YEAR, ""), r"(?i)\bet al\.?", "")
    first = F.split(F.trim(bare), r"[\s,;/&]+")[0]
    return F.regexp_replace(F.lower(first), r"^[ .,]+|[ .,]+$", "")


def citations(clause: Column) -> Column:
    """Array of struct(raw, key, external) of a clause, in order, each raw form once."""
    inner = F.array_distinct(F.regexp_extract_all(clause, F.lit(CITATION), 1))
    external = lambda x: F.lower(F.trim(x)) == "external review"
    named = lambda x: F.split(F.trim(x), r"\s+")[0].rlike(r"^[A-Z][A-Za-z\-']+$")
    kept = F.filter(inner, lambda x: external(x) | named(x))
    return F.transform(kept, lambda x: F.when(external(x), F.struct(F.lit(EXTERNAL_REVIEW).alias("raw"), F.lit("").alias("key"), F.lit(True).alias("external"))).otherwise(F.struct(F.concat(F.lit("["), x, F.lit("]")).alias("raw"), citation_key(x).alias("key"), F.lit(False).alias("external"))))


def claims(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Clauses that cite: key, line, pos, clause, citations. The body is cut at its first appendix."""
    cut = docs.withColumn(body, F.split(body_of(F.col(body)), ANY_APPENDIX)[0])
    found = clauses(cut, key, body).withColumn("citations", citations(F.col("clause")))
    return found.where(F.size("citations") > 0)


def frontmatter(md: Column) -> Column:
    return F.regexp_extract(md, r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$", 1)


def body_of(md: Column) -> Column:
    """The text after a leading frontmatter block."""
    return F.when(md.rlike(r"(?s)^---\s*\n.*?\n---\s*\n?.*$"), F.regexp_extract(md, r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$", 2)).otherwise(md)


def appendix(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, citation key, file and their first line: the provenance table of Appendix A (without one, of the whole text)."""
    after = F.split(F.col(body), APPENDIX_A, 2)
    region = F.when(F.size(after) > 1, after[1]).otherwise(F.col(body))
    lines = docs.select(key, F.posexplode(F.split(F.split(region, NEXT_SECTION, 2)[0], r"\r?\n")).alias("line", "raw"))
    each = lines.select(key, "line", F.explode(citations(F.col("raw"))).alias("c"), F.regexp_extract_all("raw", F.lit(EVIDENCE_FILE), 1).alias("files")).where("NOT c.external AND c.key <> ''")
    return each.select(key, F.col("c.key").alias("citation"), "line", F.explode("files").alias("file")).groupBy(key, "citation", "file").agg(F.min("line").alias("line"))


def nuggets(docs: DataFrame, key: str, body: str, least: int = 15) -> DataFrame:
    """key, pos, nugget: sentences of at least ``least`` characters."""
    parts = F.filter(F.transform(F.split(F.col(body), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s) >= least)
    return docs.select(key, F.posexplode(parts).alias("pos", "nugget"))


def html_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(title, r"\s+", " "))


def loose_json(raw: Column) -> Column:
    """From the first brace to the last, fences or talk around it left out; null if there is none."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))
