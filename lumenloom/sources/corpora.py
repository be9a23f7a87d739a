"""Evidence JSON and benchmark corpora as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = lambda *fields: "array<struct<" + ",".join(f"{f}:string" for f in (*fields, "source_quote")) + ">>"
#: Evidence record; unions of numbers and strings are strings.
EVIDENCE = (
    "paper_id string, relevance string, species array<string>, tissue array<string>, "
    f"diseases {_QUOTED('name')}, perturbations {_QUOTED('name', 'type')}, genes {_QUOTED('symbol', 'species')}, cell_types {_QUOTED('name')}, surface_markers {_QUOTED('marker', 'maps_to_gene')}, "
    f"frequencies {_QUOTED('cell_type', 'value', 'unit', 'of_population', 'condition')}, cohort {_QUOTED('`group`', 'n', 'unit')}, gating_thresholds {_QUOTED('marker', 'operator', 'value')}, "
    "signatures array<struct<name:string,genes:array<string>,species:string,source_quote:string>>, "
    f"study_aim {_QUOTED('statement')}, findings {_QUOTED('statement')}"
)
def _as_struct() -> str:
    """The record's DDL with the colons of a nested struct."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(EVIDENCE + ","):
        depth += c == "<"
        depth -= c == ">"
        if c == "," and not depth:
            out.append(EVIDENCE[start:i].strip().replace(" ", ":", 1))
            start = i + 1
    return ",".join(out)


#: The same as a nested struct.
EVIDENCE_STRUCT = f"struct<{_as_struct()}>"
_SUFFIX = r"(_evidence\.regrounded\.json|_evidence\.json|\.json)$"


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """One record a paper: a regrounded file supersedes its stem's plain one, the first of equal ids wins, unreadable files give none."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract("_metadata.file_path", "([^/]+)$", 1)).where("file LIKE '%.json'")
    stem = F.regexp_replace("file", _SUFFIX, "")
    preference = Window.partitionBy("stem").orderBy(F.col("file").endswith("_evidence.regrounded.json").desc(), "file")
    chosen = raw.withColumn("stem", stem).withColumn("__n", F.row_number().over(preference)).where("__n = 1")
    many = F.from_json("value", f"array<{EVIDENCE_STRUCT}>")
    single = F.from_json("value", EVIDENCE)
    listed = F.when(F.ltrim(F.col("value")).startswith("["), many).otherwise(F.array(single))
    each = chosen.select("stem", "file", F.ltrim(F.col("value")).startswith("[").alias("list"), F.posexplode(listed).alias("pos", "r")).where("r IS NOT NULL")
    fallback = F.when(F.col("list"), F.concat("stem", F.lit("#"), F.col("pos").cast("string"))).otherwise(F.col("stem"))
    records = each.select("file", "pos", fallback.alias("__fallback"), "r.*")
    records = records.withColumn("paper_id", F.coalesce(F.nullif(F.col("paper_id"), F.lit("")), F.col("__fallback"))).drop("__fallback")
    first = Window.partitionBy("paper_id").orderBy("file", "pos")
    return records.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "file", "pos")


def read_pubtator(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """PubTator blocks: doc_id, text, field, concepts (array of spellings for each identifier). ``kinds``: annotation type -> field."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("block")).where("trim(block) <> ''")
    part = lambda tag: F.regexp_extract("block", rf"(?m)^(\d+)\|{tag}\|(.*)$", 2)
    docs = blocks.select(F.regexp_extract("block", r"(?m)^(\d+)\|t\|", 1).alias("doc_id"), F.concat_ws(" ", part("t"), part("a")).alias("text"), F.explode_outer(F.regexp_extract_all("block", F.lit(r"(?m)^(\d+\t\d+\t\d+\t.*)$"), 1)).alias("line"))
    cells = F.split("line", "\t")
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    marked = docs.select("doc_id", "text", F.try_element_at(names, F.get(cells, 4)).alias("field"), F.get(cells, 3).alias("surface"), F.get(cells, 5).alias("concept")).where("field IS NOT NULL")
    by = marked.groupBy("doc_id", "text", "field", "concept").agg(F.array_sort(F.collect_set(F.lower("surface"))).alias("names"))
    return by.groupBy("doc_id", "text", "field").agg(F.array_sort(F.collect_list("names")).alias("concepts"))


def read_iob(spark: SparkSession, path: str) -> DataFrame:
    """IOB tokens (tab-separated, blank line ends a sentence, ``###`` starts a document): doc, sentence, entity, kind.

    Islands of B/I tags within one sentence; an entity never crosses sentences.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "raw"))
    order = Window.partitionBy("file").orderBy("pos")
    upto = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(order)
    cells = F.split("raw", "\t")
    tag = F.element_at(cells, -1)
    marked = lines.withColumn("doc", upto(F.col("raw").startswith("###"))).withColumn("sentence", upto(F.trim("raw") == "")).where("trim(raw) <> '' AND NOT startswith(raw, '###')")
    marked = marked.select("file", "doc", "sentence", "pos", F.get(cells, 0).alias("token"), F.substring(tag, 1, 1).alias("mark"), F.when(F.length(tag) > 2, F.substring(tag, 3, 100)).alias("kind"))
    inside = Window.partitionBy("file", "doc", "sentence").orderBy("pos")
    start = (F.col("mark") == "B") | ((F.col("mark") == "I") & (F.coalesce(F.lag("mark").over(inside), F.lit("O")) == "O"))
    islands = marked.withColumn("island", F.sum(F.when(start, 1).otherwise(0)).over(inside)).where("mark <> 'O'")
    found = islands.groupBy("file", "doc", "sentence", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"), F.min_by("kind", "pos").alias("kind"))
    return found.select("doc", "sentence", F.array_join("t.token", " ").alias("entity"), "kind")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an OBO ontology: id, name, spellings (name and EXACT synonyms, lower-cased); obsolete ones left out."""
    stanzas = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^\[")).alias("s")).where("startswith(s, 'Term]')")
    one = lambda tag: F.regexp_extract("s", rf"(?m)^{tag}: (.*)$", 1)
    exact = F.regexp_extract_all("s", F.lit(r'(?m)^synonym: "([^"]*)" EXACT'), 1)
    terms = stanzas.where(one("is_obsolete") != "true").select(F.trim(one("id")).alias("id"), F.trim(one("name")).alias("name"), exact.alias("e"))
    return terms.select("id", "name", F.array_distinct(F.transform(F.concat(F.array("name"), "e"), lambda x: F.lower(F.trim(x)))).alias("spellings"))


def unambiguous(terms: DataFrame) -> DataFrame:
    """spelling, id for spellings of exactly one term."""
    each = terms.select("id", F.explode("spellings").alias("spelling")).distinct()
    return each.groupBy("spelling").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("spelling", "id")


def read_reviews(spark: SparkSession, inputs: str, targets: str, at_least: int = 1) -> DataFrame:
    """Review groups: review_id, target, studies (struct of pmid, title, abstract) with an abstract, by file order of pmid."""
    csv = lambda p: spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(p)
    studies = csv(inputs).where("trim(coalesce(Abstract, '')) <> ''").groupBy(F.col("ReviewID").alias("review_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("PMID").alias("pmid"), F.col("Title").alias("title"), F.col("Abstract").alias("abstract")))).alias("studies"))
    goal = csv(targets).select(F.col("ReviewID").alias("review_id"), F.col("Target").alias("target"))
    return studies.where(F.size("studies") >= at_least).join(goal, "review_id")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``*_evidence.json`` files: paper_id of the record, else the file's stem; unreadable files give none."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract("_metadata.file_path", "([^/]+)$", 1)).where("file LIKE '%\\\\_evidence.json'")
    found = raw.select(F.regexp_replace("file", r"_evidence\.json$", "").alias("stem"), F.from_json("value", EVIDENCE_STRUCT).alias("r")).where("r IS NOT NULL").select("stem", "r.*")
    return found.withColumn("paper_id", F.coalesce(F.nullif(F.col("paper_id"), F.lit("")), "stem")).drop("stem")


def read_gold_key(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """paper_id, field, values of a JSONL key; a field that a line does not have is not measured and gives no row."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object("value", f"$.{f}").alias("raw")) for f in fields]))
    rows = lines.select(F.get_json_object("value", "$.paper_id").alias("paper_id"), each.alias("x")).where("paper_id IS NOT NULL AND paper_id <> '' AND x.raw IS NOT NULL")
    return rows.select("paper_id", "x.field", F.from_json("x.raw", "array<string>").alias("values"))


def read_synthesis(spark: SparkSession, path: str) -> DataFrame:
    """The optional synthesis JSON as one row of text; no row where there is none."""
    try:
        return spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string")


def read_screening(spark: SparkSession, archive: str, split: str = "dev", folder: str = "CSMeD-FT", reviews: list[str] | None = None, at_least: int = 15, most: int | None = None, criteria_chars: int = 3000) -> DataFrame:
    """Screening items of a zipped review collection: review_id, context, id, title, abstract, gold.

    Documents without an abstract are left out; without ``reviews`` those of ``at_least`` documents are taken, and of each at most
    ``most`` documents, in file order. A review without metadata gives none.
    """
    import csv
    import io
    import json
    import zipfile

    def run(pdfs):
        for pdf in pdfs:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    rows = list(csv.DictReader(io.TextIOWrapper(z.open(f"{folder}/{folder}-{split}.csv"), encoding="utf-8")))
                    meta = json.loads(z.read(f"{folder}/{folder}-{split}_reviews_metadata.json"))
                held = pd.DataFrame([(r["review_id"], k, r["document_id"], (r.get("title") or "").strip(), (r.get("abstract") or "").strip(), r["decision"]) for k, r in enumerate(rows)], columns=["review_id", "pos", "id", "title", "abstract", "decision"])
                held = held[(held["abstract"] != "") & held["review_id"].isin(list(meta))]
                held["meta"] = held["review_id"].map(lambda i: json.dumps(meta[i]))
                yield held

    import pandas as pd

    rows = spark.read.format("binaryFile").load(archive).select("content").mapInPandas(run, "review_id string, pos long, id string, title string, abstract string, decision string, meta string")
    by = Window.partitionBy("review_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("k", F.row_number().over(by.orderBy("pos")))
    rows = rows.where(F.col("review_id").isin(*reviews)) if reviews else rows.where(F.col("n") >= at_least)
    rows = rows if most is None else rows.where(F.col("k") <= most)
    said = lambda k: F.trim(F.coalesce(F.get_json_object("meta", f"$.{k}"), F.lit("")))
    criteria = said("criteria")
    cut = F.when(F.length(criteria) > criteria_chars, F.concat(F.substring(criteria, 1, criteria_chars), F.lit(" …"))).otherwise(criteria)
    context = F.concat(F.lit("Review: "), said("title"), F.lit("\nType: "), said("review_type"), F.lit("\n\nEligibility criteria:\n"), cut)
    return rows.select("review_id", context.alias("context"), "id", "title", "abstract", F.when(F.col("decision") == "included", "RELEVANT").otherwise("NOT_RELEVANT").alias("gold"))


def read_quantities(spark: SparkSession, folder: str, split: str = "eval") -> DataFrame:
    """doc_id, text, quantities of paired text and annotation files; documents without a text are left out."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.[a-z]+$", 1)
    lines = spark.read.text(f"{folder}/{split}/tsv/*.tsv", wholetext=True).select(name.alias("doc_id"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    cells = F.split("line", "\t")
    marked = lines.groupBy("doc_id").agg(F.collect_set(F.when((F.col("pos") > 0) & (F.get(cells, 2) == "Quantity"), F.lower(F.trim(F.get(cells, 6))))).alias("q"))
    texts = spark.read.text(f"{folder}/{split}/text/*.txt", wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))
    return texts.join(marked, "doc_id").select("doc_id", "text", F.array_sort(F.array_compact("q")).alias("quantities"))


# Taxon ids and the species name that stands for them.
TAXA = {
    "9606": "human", "10090": "mouse", "10116": "rat", "10029": "chinese hamster", "4932": "yeast", "7227": "drosophila", "7955": "zebrafish", "9598": "chimpanzee", "9544": "macaque",
    "9913": "bovine", "9823": "pig", "9031": "chicken", "8355": "xenopus",
}


def with_taxon(concept: Column, names: Column) -> Column:
    """Spellings of a species concept with the name of its taxon."""
    known = F.create_map(*[F.lit(x) for kv in TAXA.items() for x in kv])
    name = F.try_element_at(known, concept)
    return F.when(name.isNotNull(), F.array_sort(F.array_union(names, F.array(name)))).otherwise(names)


def cell_candidates(surface: Column) -> Column:
    """A cell type's surface form and its singular forms, each once."""
    s = F.lower(F.trim(F.regexp_replace(surface, r"\s+", " ")))
    return F.filter(F.array_distinct(F.array(s, F.regexp_replace(s, r"\bcells\b", "cell"), F.when(s.endswith("s"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s))), lambda x: x != "")


def cell_concepts(surfaces: DataFrame, key: str, surface: str, terms: DataFrame) -> DataFrame:
    """key, concept, spellings: surfaces grouped by the ontology term (id, spellings) that one of their forms names; unknown ones stay alone (``~`` and the surface)."""
    rows = surfaces.select(key, F.lower(F.trim(F.regexp_replace(surface, r"\s+", " "))).alias("s")).distinct()
    forms = rows.select(key, "s", F.posexplode(cell_candidates(F.col("s"))).alias("k", "spelling"))
    first = forms.join(unambiguous(terms), "spelling").groupBy(key, "s").agg(F.min_by("id", "k").alias("id"))
    named = rows.join(first, [key, "s"], "left").join(terms.select("id", "spellings"), "id", "left")
    each = named.select(key, F.coalesce("id", F.concat(F.lit("~"), "s")).alias("concept"), F.array_union(F.coalesce("spellings", F.array().cast("array<string>")), F.array("s")).alias("x"))
    return each.groupBy(key, "concept").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))).alias("spellings"))


def spellings_by_id(labelled: DataFrame, terms: DataFrame) -> DataFrame:
    """``labelled`` (id, label and any columns) with spellings: those of the term and the label itself."""
    joined = labelled.join(terms.select("id", F.col("spellings").alias("__s")), "id", "left")
    own = F.when(F.coalesce("label", F.lit("")) != "", F.array(F.lower(F.trim("label")))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("spellings", F.array_sort(F.array_union(F.coalesce("__s", F.array().cast("array<string>")), own))).drop("__s")


def read_collections(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """doc_id, text, concepts (spellings of each curated cell type) of a crawl of study collections; those without text or concept are left out."""
    shape = "array<struct<collection_id:string,text:string,cl_ids:array<string>,cl_labels:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", shape)))
    each = rows.where("trim(coalesce(text, '')) <> ''").select(F.col("collection_id").alias("doc_id"), "text", F.explode(F.arrays_zip(F.col("cl_ids").alias("id"), F.col("cl_labels").alias("label"))).alias("x")).select("doc_id", "text", "x.id", "x.label")
    return spellings_by_id(each, terms).where(F.size("spellings") > 0).groupBy("doc_id", "text").agg(F.array_sort(F.collect_set("spellings")).alias("concepts"))


def freeze_terms(terms: DataFrame, path: str) -> None:
    """Terms as JSON lines of id and sorted spellings, one file."""
    terms.select("id", F.array_sort("spellings").alias("spellings")).orderBy("id").coalesce(1).write.mode("overwrite").json(path)


def read_env(body: str) -> dict[str, str]:
    """Settings of a ``.env`` text: KEY=VALUE lines, ``export`` and quotes aside, comments and the rest left out."""
    out = {}
    for line in body.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out


def read_benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    """model, topic, keep_f1, prevalence of a triage benchmark's CSV."""
    rows = spark.read.option("header", True).csv(path)
    n = lambda c: F.col(c).cast("double")
    kept = n("tp") + n("fn")
    return rows.select("model", "topic", n("keep_f1").alias("keep_f1"), F.try_divide(kept, kept + n("fp") + n("tn")).alias("prevalence"))
