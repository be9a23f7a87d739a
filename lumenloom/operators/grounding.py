"""Structured evidence records: checks, items, grounding by quote, by retrieval and by a finder, and a rule-based structurer."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import lexical, text
from lumenloom.operators import evidence, parsing
from lumenloom.sources.corpora import EVIDENCE, EVIDENCE_STRUCT

# What an item of each field must hold, and which check its claims need.
REQUIRED = {
    "diseases": ("name", "source_quote"), "perturbations": ("name", "source_quote"), "genes": ("symbol", "source_quote"), "cell_types": ("name", "source_quote"), "surface_markers": ("marker", "source_quote"),
    "frequencies": ("cell_type", "value", "source_quote"), "cohort": ("group", "n", "source_quote"), "gating_thresholds": ("marker", "source_quote"), "signatures": ("name", "genes", "source_quote"),
    "study_aim": ("statement", "source_quote"), "findings": ("statement", "source_quote"),
}
KIND = {
    "diseases": "entity", "perturbations": "entity", "genes": "entity", "cell_types": "entity", "surface_markers": "entity", "frequencies": "number", "cohort": "number", "gating_thresholds": "number",
    "signatures": "entity", "study_aim": "claim", "findings": "claim",
}
NOT_CLAIMED = ("source_quote", "maps_to_gene")
MARKER = r"\b(CD\d+[a-z]?|HLA-DR|PD-1|PD-L1)\b"
GENES = ("FOXP3", "CD4", "CD8A", "CD8", "GZMB", "PRF1", "NKG7", "MS4A1", "CD19", "CD14", "IL2RA", "CTLA4", "IL7R", "CCR7", "FCGR3A")

Verifier = Callable[[Column, Column], Column]


def _fields(records: DataFrame) -> dict[str, list]:
    """The item fields of the records at hand, with their members."""
    return {f.name: f.dataType.elementType.fields for f in records.schema.fields if f.name in KIND}


def coerce(raw: Column) -> Column:
    """Record struct of a model's answer: JSON found in it, absent lists empty, items that are no objects left out, species and tissue as strings."""
    body = parsing.loose_json(raw)
    found = F.from_json(body, EVIDENCE_STRUCT)
    loose = F.from_json(body, "struct<species:array<string>,tissue:array<string>>")
    named = lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.symbol"), F.when(~F.startswith(F.ltrim(x), F.lit("{")), x))
    strings = lambda c: F.filter(F.transform(F.coalesce(loose[c], F.array().cast("array<string>")), named), lambda s: s.isNotNull() & (s != ""))
    out = []
    for name in (x.split(" ", 1)[0] for x in _members(EVIDENCE)):
        if name in ("species", "tissue"):
            out.append(strings(name).alias(name))
        elif name in KIND:
            out.append(F.filter(F.coalesce(found[name], F.from_json(F.lit("[]"), _kind_of(name))), lambda x: x.isNotNull()).alias(name))
        else:
            out.append(found[name].alias(name))
    return F.struct(*out)


def _members(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return parts


def _kind_of(name: str) -> str:
    return next(x.split(" ", 1)[1] for x in _members(EVIDENCE) if x.split(" ", 1)[0] == name)


def empty_records(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    """Records without content, not useful."""
    made = F.from_json(F.lit('{"relevance": "NOT_USEFUL"}'), EVIDENCE_STRUCT)
    rows = spark.createDataFrame([(x,) for x in ids], "id string").select("id", made.alias("r"))
    names = [x.split(" ", 1)[0] for x in _members(EVIDENCE)]
    blank = lambda n: F.from_json(F.lit("[]"), _kind_of(n)) if _kind_of(n).startswith("array") else F.col(f"r.{n}")
    return rows.select(*[(F.col("id") if n == "paper_id" else blank(n)).alias(n) for n in names])


def _lacks(name: str, need: str):
    return lambda x, i: F.when(x.isNull() | x[need].isNull(), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"] lacks {need}")))


def _item(name: str, members: list):
    value = lambda x, m: F.array_join(x[m.name], " ") if m.dataType.simpleString() == "array<string>" else x[m.name].cast("string")
    claim = lambda x: F.array_join(F.filter(F.array(*[value(x, m) for m in members if m.name not in NOT_CLAIMED]), lambda v: v.isNotNull() & (v != "")), " ")
    return lambda x, i: F.struct(F.lit(name).alias("field"), i.cast("long").alias("pos"), claim(x).alias("claim"), x["source_quote"].alias("quote"))


def problems(records: DataFrame) -> DataFrame:
    """paper_id and errors (array of what is wrong; empty: valid)."""
    said = [F.when(~F.coalesce(F.col("relevance").isin(*lexical.RELEVANCE), F.lit(False)), F.array(F.concat(F.lit("relevance is "), F.coalesce("relevance", F.lit("null"))))).otherwise(F.array().cast("array<string>"))]
    for name, members in _fields(records).items():
        for need in REQUIRED[name]:
            if need in {m.name for m in members}:
                found = F.transform(F.coalesce(name, F.array().cast(records.schema[name].dataType)), _lacks(name, need))
                said.append(F.filter(found, lambda e: e.isNotNull()))
    return records.select("paper_id", F.concat(*said).alias("errors"))


def items(records: DataFrame) -> DataFrame:
    """paper_id, field, pos, claim (values of the item, but for its quote and mapped gene), quote, strict.

    strict: a proposition, or a numeric item that states a number, needs the strict verifier; mentions do not.
    """
    each = [F.transform(F.filter(F.coalesce(name, F.array().cast(records.schema[name].dataType)), lambda x: x.isNotNull()), _item(name, members)) for name, members in _fields(records).items()]
    rows = records.select("paper_id", F.explode(F.concat(*each)).alias("x")).select("paper_id", "x.*")
    numbered = F.col("field").isin(*[f for f, k in KIND.items() if k == "number"]) & (F.size(text.standalone_numbers(F.col("claim"))) > 0)
    return rows.withColumn("strict", F.col("field").isin(*[f for f, k in KIND.items() if k == "claim"]) | numbered)


def by_quote(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with grounded: the quote stands in the paper (sources: paper_id, text)."""
    return found.join(sources.select("paper_id", F.col("text").alias("__text")), "paper_id", "left").withColumn("grounded", text.quote_in_source(F.col("quote"), F.col("__text"))).drop("__text")


def counts(found: DataFrame, keys: Sequence[str] = ("paper_id", "field")) -> DataFrame:
    """keys, grounded, flagged and value_checked (strict items)."""
    return found.groupBy(*keys).agg(F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("flagged"), F.count_if("strict").alias("value_checked"))


def minicheck(predict: Callable[[Column, Column], Column]) -> Verifier:
    """A verifier that rejects a claim whose numbers are not in the passage and leaves the rest to ``predict`` (boolean)."""

    def verify(claim: Column, passage: Column) -> Column:
        stated = F.forall(text.standalone_numbers(claim), lambda n: F.contains(F.lower(F.coalesce(passage, F.lit(""))), n))
        ok = stated & F.coalesce(predict(claim, passage), F.lit(False))
        return F.struct(ok.alias("ok"), F.when(ok, 1.0).otherwise(0.0).alias("score"))

    return verify


def reground(found: DataFrame, sources: DataFrame, embed: Callable[[Column], Column] = lexical.hash_embedding, verifier: Verifier = text.supported, value_verifier: Verifier | None = None, k: int = 3, size: int = 800, overlap: int = 120) -> DataFrame:
    """Items with grounded and quote replaced by the passage that supports them (null where none does).

    The ``k`` passages of the paper that are nearest to a claim are retrieved, and the claim is verified against all of them; strict
    items go to ``value_verifier``. Passages meet only the claims of their own paper.
    """
    parts = evidence.passages(sources, "paper_id", "text", size, overlap).withColumn("v", embed(F.col("passage"))).withColumnRenamed("pos", "part")
    keys = ["paper_id", "field", "pos"]
    near = found.withColumn("q", embed(F.col("claim"))).join(parts, "paper_id").select(*keys, "claim", "passage", F.struct((-F.round(evidence.cosine(F.col("q"), F.col("v")), 9)).alias("c"), "part", "passage").alias("x"))
    best = near.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, k), lambda x: x["passage"]).alias("__passages"))
    both = found.join(best, keys, "left").withColumn("__passages", F.coalesce("__passages", F.array().cast("array<string>")))
    joined = F.array_join("__passages", "  ...  ")
    strict = (value_verifier or verifier)(F.col("claim"), joined)["ok"]
    judged = both.withColumn("grounded", F.coalesce(F.when(F.col("strict"), strict).otherwise(verifier(F.col("claim"), joined)["ok"]), F.lit(False)))
    words = text.content_words(F.col("claim"))
    shared = F.transform("__passages", lambda p, i: F.struct((-F.size(F.array_intersect(words, text.content_words(p)))).alias("n"), i.alias("i"), p.alias("p")))
    quote = F.substring(text.squeeze(F.array_min(shared)["p"]), 1, 240)
    return judged.withColumn("quote", F.when(F.col("grounded"), quote)).drop("__passages")


def rescue(judged: DataFrame, sources: DataFrame, finder: Callable[[Column, Column], Column], verifier: Verifier = text.supported, value_verifier: Verifier | None = None) -> DataFrame:
    """Items with rescued: of those not grounded, the ones for which ``finder`` (claim, text -> span) names a span that is in the paper and supports the claim."""
    rows = judged.join(sources.select("paper_id", F.col("text").alias("__text")), "paper_id", "left").withColumn("__span", F.coalesce(F.trim(finder(F.col("claim"), F.col("__text"))), F.lit("")))
    ok = F.when(F.col("strict"), (value_verifier or verifier)(F.col("claim"), F.col("__span"))["ok"]).otherwise(verifier(F.col("claim"), F.col("__span"))["ok"])
    saved = ~F.col("grounded") & (F.col("__span") != "") & text.quote_in_source(F.col("__span"), F.col("__text")) & ok
    done = rows.withColumn("rescued", F.coalesce(saved, F.lit(False)))
    quote = F.when(F.col("rescued"), F.substring(text.squeeze(F.col("__span")), 1, 240)).otherwise(F.col("quote"))
    return done.withColumn("quote", quote).withColumn("grounded", F.col("grounded") | F.col("rescued")).drop("__text", "__span")


def front_value(md: Column, name: str) -> Column:
    """A frontmatter value as strings: a scalar (cut at commas), ``[a, b]`` or a block list; empty if there is none."""
    return head_value(parsing.frontmatter(md), name)


def head_value(head: Column, name: str) -> Column:
    """``front_value`` of a frontmatter block."""
    inline = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    block = F.regexp_extract_all(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), 1)
    cells = F.split(F.regexp_replace(inline, r"^\[|\]$", ""), ",")
    clean = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.filter(F.transform(F.when(inline == "", block).otherwise(cells), clean), lambda x: x != "")


def front_text(md: Column) -> Column:
    """Frontmatter values as searchable text."""
    lines = F.regexp_extract_all(parsing.frontmatter(md), F.lit(r"(?m)^(?:[A-Za-z_][A-Za-z0-9_]*:|[ \t]*-)[ \t]*(.+)$"), 1)
    return F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\[\]'\"]", ""))), " . ")


def stub_records(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of notes (paper_id, text) by rules: frontmatter fields, markers and genes of the body; quotes are windows of the paper's text."""
    rows = notes.select("paper_id", F.col("text").alias("md")).join(sources.select("paper_id", F.col("text").alias("source")), "paper_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    # what several fields ask for is computed once a row, and patterns are constant
    rows = rows.select("paper_id", "source", parsing.frontmatter(F.col("md")).alias("head"), parsing.body_of(F.col("md")).alias("body"))
    listed = {c: head_value(F.col("head"), c).alias(c) for c in ("relevance", "species", "tissue", "cell_types")}
    named = [F.when(F.col("body").rlike(rf"(?i)(?<![A-Za-z0-9]){re.escape(g)}(?![A-Za-z0-9])"), g) for g in GENES]
    rows = rows.select("paper_id", F.struct("source", F.lower("source").alias("low")).alias("paper"), *listed.values(), F.regexp_extract_all("body", F.lit(MARKER), 1).alias("marked"), F.array_compact(F.array(*named)).alias("named"))
    quote = lambda term: text.squeeze(lexical.window(F.col("paper.source"), term, low=F.col("paper.low")))
    species = F.col("species")
    cells = F.transform("cell_types", lambda n: F.struct(n.alias("name"), quote(F.trim(F.split(n, r"\(")[0])).alias("source_quote")))
    once = text.bind(F.col("marked"), lambda m: F.filter(m, lambda x, i: F.array_position(F.transform(m, lambda y: F.lower(y)), F.lower(x)) == i + 1))
    genes = F.col("named")
    return rows.select(
        "paper_id", lexical.relevance(F.try_element_at("relevance", F.lit(1))).alias("relevance"), "species", "tissue", cells.alias("cell_types"),
        F.transform(once, lambda m: F.struct(m.alias("marker"), F.lit("").alias("maps_to_gene"), quote(m).alias("source_quote"))).alias("surface_markers"),
        F.transform(genes, lambda g: F.struct(g.alias("symbol"), F.coalesce(F.try_element_at(species, F.lit(1)), F.lit("")).alias("species"), quote(g).alias("source_quote"))).alias("genes"),
    )


def structure(notes: DataFrame, sources: DataFrame, structurer: Callable[[DataFrame, DataFrame], DataFrame] = stub_records) -> tuple[DataFrame, DataFrame]:
    """Records by a structurer, and by paper: items, grounded, ungrounded (by quote), schema_errors."""
    records = structurer(notes, sources)
    found = by_quote(items(records), sources).groupBy("paper_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("ungrounded"))
    wrong = problems(records).select("paper_id", F.size("errors").cast("long").alias("schema_errors"))
    return records, wrong.join(found, "paper_id", "left").na.fill(0, ["items", "grounded", "ungrounded"])


def read_battery(spark: SparkSession, path: str) -> DataFrame:
    """Labelled claims: passage, claim, gold, mode."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "cases array<struct<passage:string,claim:string,gold:boolean,mode:string>>").alias("x"))
    return raw.select(F.inline("x.cases"))


def score_battery(cases: DataFrame, verifier: Verifier = text.supported) -> DataFrame:
    """mode (null: all), n, correct, accuracy of a verifier on labelled claims."""
    right = F.coalesce(verifier(F.col("claim"), F.col("passage"))["ok"], F.lit(False)) == F.col("gold")
    found = cases.withColumn("__right", right).rollup("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("__right").alias("correct"))
    return found.withColumn("accuracy", F.col("correct") / F.col("n"))
