"""Faithfulness, citations and structure of a written synthesis, by rules: no model, every run alike.

A synthesis is Markdown with ``[Author Year]`` markers and a provenance table (Appendix A) that maps authors to
evidence files. ``docs`` has a key and a body; ``notes`` has the same key, file and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import lexical, text
from lumenloom.operators import evidence, parsing, texts_asked
from lumenloom.runtime import materialize

# Entity tokens and the ones that are none, quantities, counted things, alias groups, labels and notes.
ENTITY = r"\b(?:CD\d+[A-Za-z]?|[A-Z][A-Za-z]*\d[A-Za-z0-9\-]*|[A-Z]{3,}(?:-[A-Za-z]+)?)\b"
ENTITY_STOP = (
    "DNA", "RNA", "AND", "THE", "FOR", "WITH", "NK", "PCA", "UMAP", "TSNE", "GPU", "CPU", "AUC", "AUROC", "AUPRC", "ROC", "FACS", "FDR", "PBMC", "ATAC", "QC", "API", "CSV", "JSON", "HTML",
    "CORE", "SUPPORTING", "EXPLORATORY", "YES", "MIXED", "HIGH", "MODERATE", "LOW", "TBD", "NA",
)
QUANTITY = r"(?<![\d.])\d+(?:\.\d+)?\s*[%‰]"
RANK_MARK = r"#\s*\d+|\bno\.?\s*\d+\b"
COUNTED = r"(?is)^.*?\b(\d+)\s+(?:[a-z]+\s+){0,3}(methods|papers|studies|markers|genes|datasets)\b(.*)$"
ALIAS_GROUPS = (
    ("cd25", "il2ra"), ("cd279", "pdcd1", "pd-1", "pd1"), ("pd-l1", "cd274"), ("cd20", "ms4a1"), ("foxp3", "scurfin"), ("cd45", "cd45ra", "cd45ro", "cd45rb", "ptprc"), ("cd8", "cd8a", "cd8b"),
    ("cd3", "cd3d", "cd3e", "cd3g"), ("cd127", "il7r"), ("cd16", "fcgr3a"), ("cd56", "ncam1"), ("cd169", "siglec1"), ("cd21", "cr2"), ("cd11b", "itgam"), ("cd11c", "itgax"), ("cd123", "il3ra"),
    ("cd62l", "sell"), ("ccr7", "cd197"), ("ctla4", "cd152"), ("cd138", "sdc1"), ("cd117", "kit"),
)
SUPPORTIVE, PARTIAL, CONTRADICTORY, IRRELEVANT = LABELS = ("Supportive", "Partial", "Contradictory", "Irrelevant")
EXTERNAL_NOTE, UNRESOLVED_NOTE, MISSING_NOTE = "external review — skipped (no evidence file)", "unresolved — no Appendix-A entry", "evidence file missing/empty"
THRESHOLD = 0.3

Verifier = Callable[[Column, Column], Column]  # (claim, passage) -> struct(ok, score)
Labeler = Callable[[Column, Column], Column]  # (claim, passage) -> one of LABELS, or anything else


def plain(x: Column) -> Column:
    """Squeezed, lower-cased, edge punctuation removed."""
    return F.regexp_replace(F.lower(text.squeeze(x)), r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")


def aliases(symbol: Column) -> Column:
    """Accepted spellings of a gene or marker: its own and those of its group; none of a blank."""
    s = plain(F.coalesce(symbol, F.lit("")))
    known = text.constant_map({name: group for group in ALIAS_GROUPS for name in group})
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_union(F.array(s), F.coalesce(F.try_element_at(known, s), F.array().cast("array<string>"))))


def entities(claim: Column) -> Column:
    """Domain entities of a claim in order, each once by its normalised form."""
    found = F.filter(F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(f"({ENTITY})"), 1), lambda x: ~F.upper(x).isin(*ENTITY_STOP) & (plain(x) != ""))
    return text.bind(found, lambda every: F.filter(every, lambda x, i: F.array_position(F.transform(every, plain), plain(x)) == i + 1))


def number_grounded(claim: Column, passage: Column) -> Column:
    """Whether every number of the claim stands in the passage, with its percent or per-mille sign if it has one."""
    held = F.lower(F.coalesce(passage, F.lit("")))
    said = F.regexp_replace(F.lower(claim), RANK_MARK, " ")
    quantities = F.regexp_extract_all(said, F.lit(f"({QUANTITY})"), 1)
    parts = lambda q, k: F.regexp_extract(q, r"(\d+(?:\.\d+)?)\s*([%‰])", k)
    rest = text.numbers(F.regexp_replace(said, QUANTITY, " "))

    def stands(low: Column) -> Column:
        whole = F.forall(quantities, lambda q: F.regexp_like(low, F.concat(F.lit(r"(?<![\d.])\Q"), parts(q, 1), F.lit(r"\E\s*"), parts(q, 2))))
        return whole & F.forall(rest, lambda n: F.regexp_like(low, F.concat(F.lit(r"(?<![\d.])\Q"), n, F.lit(r"\E(?![\d.])"))))

    return text.bind(held, stands)


def entity_grounded(claim: Column, passage: Column) -> Column:
    """Whether every entity of the claim, under any of its spellings, stands in the passage."""
    return text.bind(plain(F.coalesce(passage, F.lit(""))), lambda held: F.forall(entities(claim), lambda e: F.exists(aliases(e), lambda a: F.contains(held, a))))


def cited_claims(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, line, pos, claim (the clause without markers) and citations of every clause that cites."""
    found = parsing.claims(docs, key, body).withColumn("claim", F.regexp_replace(F.regexp_replace("clause", parsing.CITATION, ""), r"^[ \t·\-—|]+|[ \t·\-—|]+$", ""))
    return found.where("claim <> ''").select(key, "line", "pos", "claim", "citations")


def all_clauses(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, line, pos, clause: declarative clauses before the first appendix, cited or not, headings and scraps left out."""
    cut = docs.withColumn(body, F.split(parsing.body_of(F.col(body)), parsing.ANY_APPENDIX)[0])
    return parsing.clauses(cut, key, body).where((F.length("clause") >= 8) & ~F.col("clause").startswith("#"))


def _citing(claims: DataFrame, key: str) -> DataFrame:
    return claims.select(key, "line", "pos", "claim", F.posexplode("citations").alias("cite", "c")).select(key, "line", "pos", "claim", "cite", "c.raw", F.col("c.key").alias("citation"), "c.external")


def _filled(notes: DataFrame) -> DataFrame:
    return notes.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def resolved(claims: DataFrame, mapping: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """key, line, pos, claim, raw citations and files: the filled files that the claim cites, each once, in order of citation."""
    cites = _citing(claims, key).where("NOT external AND citation <> ''")
    held = mapping.select(key, "citation", "file", F.col("line").alias("entry"))
    each = cites.join(held, [key, "citation"]).join(_filled(notes).select(key, "file").distinct(), [key, "file"])
    once = each.groupBy(key, "line", "pos", "claim", "file").agg(F.min(F.struct("cite", "entry", "file")).alias("at"))
    listed = once.groupBy(key, "line", "pos", "claim").agg(F.array_sort(F.collect_list("at")).alias("x"))
    raw = claims.select(key, "line", "pos", F.array_join(F.transform("citations", lambda c: c["raw"]), "; ").alias("citations"))
    return listed.select(key, "line", "pos", "claim", F.transform("x", lambda r: r["file"]).alias("files")).join(raw, [key, "line", "pos"])


def _needs(claim: Column) -> Column:
    """What a claim needs of its files: signed (s) and other (n) numbers, entities (e) under any of their spellings."""
    said = F.regexp_replace(F.lower(claim), RANK_MARK, " ")
    need = lambda kind, values: F.struct(F.lit(kind).alias("kind"), values.alias("values"))
    quantities = F.transform(F.regexp_extract_all(said, F.lit(f"({QUANTITY})"), 1), lambda q: need("s", F.array(F.regexp_replace(q, r"\s+", ""))))
    numbers = F.transform(text.numbers(F.regexp_replace(said, QUANTITY, " ")), lambda n: need("n", F.array(n)))
    return F.array_distinct(F.concat(quantities, numbers, F.transform(entities(claim), lambda e: need("e", aliases(e)))))


def _grounded(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """id, number_grounded, entity_grounded of ``rows`` (id, claim, places): what the claim needs, against what stands in the texts of its places.

    A number equals a whole run of digits and points; one with a sign may end a text whose successor begins with the sign.
    """
    asked = materialize(rows.select("id", "places", F.explode_outer(_needs(F.col("claim"))).alias("need")).select("id", "need", "places", F.col("need.kind").alias("kind")), "needs")
    each = asked.select("id", "need", "kind", F.explode("places").alias("place"), "need.values").select("id", "need", "kind", "place", F.explode("values").alias("value"))
    facts = texts_asked.runs(texts).withColumn("kind", F.lit("n")).unionByName(texts_asked.signed(texts).withColumn("kind", F.lit("s")))
    facts = facts.unionByName(texts_asked.inside(each.where("kind = 'e'").select("place", "value"), texts).withColumn("kind", F.lit("e")))
    met = each.join(facts, ["place", "value", "kind"], "left_semi").select("id", "need")
    edges = texts.select("place", F.regexp_extract(F.lower("text"), r"(?<![\d.])([\d.]+)\s*\z", 1).alias("tail"), F.regexp_extract("text", r"\A\s*([%‰])", 1).alias("head"))
    several = asked.where("kind = 's' AND size(places) > 1").select("id", "need", F.posexplode("places").alias("nth", "place")).join(edges, "place")
    left, right = several.select("id", "need", "nth", "tail"), several.select("id", "need", (F.col("nth") - 1).alias("nth"), "head")
    across = left.join(right, ["id", "need", "nth"]).where((F.col("tail") != "") & (F.col("head") != "") & (F.concat("tail", "head") == F.col("need.values")[0]))
    held = met.unionByName(across.select("id", "need")).distinct().withColumn("held", F.lit(True))
    whole = asked.join(held, ["id", "need"], "left").withColumn("held", F.col("held").isNotNull() | F.col("need").isNull())
    every = lambda kinds: F.coalesce(F.bool_and(F.when(F.col("kind").isin(*kinds), F.col("held"))), F.lit(True))
    return whole.groupBy("id").agg(every(("n", "s")).alias("number_grounded"), every(("e",)).alias("entity_grounded"))


def score_claims(claims: DataFrame, mapping: DataFrame, notes: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row a claim with evidence: number_grounded, entity_grounded, lexical_overlap, passed, reason.

    Files are not joined to claims: each file is read once, and claims meet what it holds.
    """
    texts = materialize(_filled(notes).groupBy(F.struct(key, "file").alias("place")).agg(F.first("text").alias("text")), "notes")
    rows = materialize(resolved(materialize(claims, "claims"), mapping, texts.select("place.*", "text"), key).withColumn("id", F.monotonically_increasing_id()), "resolved")
    placed = rows.select("id", "claim", F.transform("files", lambda f: F.struct(F.col(key), f.alias("file"))).alias("places"))
    grounded = _grounded(placed, texts)
    asked = placed.select("id", F.explode("places").alias("place"), F.array_sort(text.tokens(F.col("claim"), 1)).alias("w"))
    overlap = texts_asked.best_f1(asked, texts, evidence.SENTENCE)
    every = rows.join(grounded, "id").join(overlap, "id", "left")
    checked = every.select(key, "line", "pos", "claim", "citations", "files", "number_grounded", "entity_grounded", F.round(F.coalesce("f1", F.lit(0.0)), 3).alias("lexical_overlap"))
    far = F.col("lexical_overlap") < threshold
    why = F.array_compact(F.array(F.when(~F.col("number_grounded"), "number not grounded"), F.when(~F.col("entity_grounded"), "entity not grounded"), F.when(far, F.concat(F.lit("lexical_overlap "), F.col("lexical_overlap").cast("string"), F.lit(f" < {threshold}")))))
    return checked.withColumn("passed", F.col("number_grounded") & F.col("entity_grounded") & ~far).withColumn("reason", F.array_join(why, "; "))


def rate(a: Column, b: Column) -> Column:
    """Three digits; null of nothing."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 3)


def faithfulness(scores: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, n_scored_claims and the rates of claims that pass each check and all of them."""
    n = F.count(F.lit(1))
    share = lambda c, name: rate(F.count_if(c), n).alias(name)
    return scores.groupBy(key).agg(n.alias("n_scored_claims"), share(F.col("passed"), "faithfulness_rate"), share(F.col("number_grounded"), "number_grounded_rate"), share(F.col("entity_grounded"), "entity_grounded_rate"), share(F.col("lexical_overlap") >= threshold, "lexical_overlap_rate"))


def flagged(scores: DataFrame) -> DataFrame:
    """Claims that failed, with the reason."""
    return scores.where("NOT passed")


def count_checks(clauses: DataFrame, key: str) -> DataFrame:
    """key, claim, claimed, listed, ok: clauses that count things and list them next to the count."""
    bare = clauses.select(key, F.trim(F.regexp_replace("clause", parsing.CITATION, "")).alias("claim"))
    tail = F.regexp_extract("claim", COUNTED, 3)
    items = F.filter(F.transform(F.split(tail, r"[,;]|\band\b|\bor\b"), lambda x: F.trim(x)), lambda x: x != "")
    found = bare.where(F.col("claim").rlike(COUNTED)).select(key, "claim", F.regexp_extract("claim", COUNTED, 1).cast("long").alias("claimed"), items.alias("items"))
    found = found.where((F.size("items") >= 2) & lexical.looks_like_list(F.col("items")))
    return found.select(key, "claim", "claimed", F.size("items").cast("long").alias("listed"), (F.col("claimed") == F.size("items")).alias("ok"))


def structure(docs: DataFrame, notes: DataFrame, key: str, body: str) -> DataFrame:
    """key with the uncited, dangling and coverage rates, the evidence files that no claim cites, and count_consistent."""
    mapping, clauses, claims = parsing.appendix(docs, key, body), all_clauses(docs, key, body), cited_claims(docs, key, body)
    uncited = clauses.groupBy(key).agg(F.count(F.lit(1)).alias("n_clauses"), F.count_if(F.size(parsing.citations(F.col("clause"))) == 0).alias("n_uncited_claims"))
    cites = _citing(claims, key).where("NOT external")
    present = _filled(notes).select(key, "file").distinct()
    entries = cites.join(mapping.select(key, "citation", "file"), [key, "citation"], "left")
    held = entries.join(present.withColumn("there", F.lit(True)), [key, "file"], "left").groupBy(key, "line", "pos", "cite", "citation").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("resolves"))
    markers = held.where("citation <> ''").groupBy(key).agg(F.count(F.lit(1)).alias("n_citation_markers"), F.count_if(~F.col("resolves")).alias("n_dangling"))
    cited = cites.select(key, "line", "pos").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_cited_claims"))
    used = entries.where("file IS NOT NULL").select(key, "file").distinct().withColumn("used", F.lit(True))
    cover = present.join(used, [key, "file"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("evidence_total"), F.count("used").alias("evidence_used"), F.array_sort(F.collect_list(F.when(F.col("used").isNull(), F.col("file")))).alias("evidence_uncited"))
    consistent = count_checks(clauses, key).groupBy(key).agg(F.bool_and("ok").alias("count_consistent"))
    whole = docs.select(key).distinct()
    for part in (uncited, markers, cited, cover, consistent):
        whole = whole.join(part, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return whole.select(
        key, *map(n, ("n_clauses", "n_cited_claims", "n_uncited_claims", "n_citation_markers", "n_dangling", "evidence_used", "evidence_total")), rate(F.col("n_uncited_claims"), F.col("n_clauses")).alias("uncited_claim_rate"),
        rate(F.col("n_dangling"), F.col("n_citation_markers")).alias("dangling_rate"), rate(F.col("evidence_used"), F.col("evidence_total")).alias("coverage"),
        F.coalesce("evidence_uncited", F.array().cast("array<string>")).alias("evidence_uncited"), F.coalesce("count_consistent", F.lit(True)).alias("count_consistent"),
    )


def pairings(claims: DataFrame, mapping: DataFrame, notes: DataFrame, key: str, verifier: Verifier = text.supported, labeler: Labeler | None = None) -> DataFrame:
    """One row for each claim, citation and file: label and note. External and unresolved citations are told, not judged.

    A labeler may tell all four labels; what else it says, and claims without one, go by the verifier.
    """
    cites = _citing(claims, key).join(mapping.select(key, "citation", "file", F.col("line").alias("entry")), [key, "citation"], "left")
    plain_rule = verifier is text.supported and labeler is None
    if plain_rule:  # files meet claims by what they hold
        held = materialize(notes.select(key, "file", "text").withColumn("place", F.monotonically_increasing_id()), "notes")
        each = cites.join(held.select(key, "file", "place", (F.coalesce("text", F.lit("")) == "").alias("blank")), [key, "file"], "left")
        missing = F.coalesce("blank", F.lit(True))
    else:
        each = cites.join(notes.select(key, "file", "text"), [key, "file"], "left")
        missing = F.coalesce(F.col("text"), F.lit("")) == ""
    note = F.when(F.col("external"), EXTERNAL_NOTE).when(F.col("file").isNull(), UNRESOLVED_NOTE).when(missing, MISSING_NOTE).otherwise("")
    each = each.withColumn("note", note)
    if plain_rule:
        each = materialize(each, "pairings")
        told = F.when(F.col("ok"), SUPPORTIVE).otherwise(IRRELEVANT)
        each = each.join(supported(each.where("note = ''").select("place", "claim").distinct(), held), ["place", "claim"], "left")
    else:
        told = F.when(verifier(F.col("claim"), F.col("text"))["ok"], SUPPORTIVE).otherwise(IRRELEVANT)
    if labeler is not None:
        own = labeler(F.col("claim"), F.col("text"))
        told = F.when(own.isin(*LABELS), own).otherwise(told)
    judged = each.withColumn("label", F.when(F.col("note") == "", told).otherwise(IRRELEVANT))
    return judged.select(key, "line", "pos", "claim", F.col("raw").alias("citation"), F.when(F.col("external"), "").otherwise(F.coalesce("file", F.lit(""))).alias("evidence_file"), "label", "note")


def supported(asked: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """``asked`` (place, claim; each once) with ok, as ``text.supported`` tells of the text of the place (``texts``: place, text, written)."""
    rows = materialize(asked.withColumn("id", F.monotonically_increasing_id()), "asked")
    words = rows.select("id", "place", F.explode(text.content_words(F.col("claim"))).alias("word"))
    hits = words.join(texts.select("place", F.explode(text.content_words(F.col("text"))).alias("word")), ["place", "word"]).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    stated = rows.select("id", "place", F.explode(F.array_distinct(text.standalone_numbers(F.col("claim")))).alias("value"))
    absent = stated.join(texts_asked.numbers_inside(stated.select("place", "value"), texts), ["place", "value"], "left_anti").select("id").distinct().withColumn("absent", F.lit(True))
    n = F.size(text.content_words(F.col("claim")))
    return rows.join(hits, "id", "left").join(absent, "id", "left").select("place", "claim", ((n > 0) & (F.coalesce("hits", F.lit(0)) / n >= least) & F.col("absent").isNull()).alias("ok"))


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs that were judged."""
    return pairs.where((F.col("citation") != parsing.EXTERNAL_REVIEW) & (F.col("evidence_file") != "") & ~F.col("note").contains("missing"))


def citation_metrics(claims: DataFrame, pairs: DataFrame, mapping: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """key with citation precision, claim recall, coverage and a count of each label."""
    judged = scored(pairs)
    counts = judged.groupBy(key).agg(F.count(F.lit(1)).alias("n_scored_pairs"), *[F.count_if(F.col("label") == x).alias(x.lower()) for x in LABELS])
    full = judged.groupBy(key, "claim").agg(F.bool_and(F.col("label") == SUPPORTIVE).alias("full"))
    inside = claims.select(key, "claim", F.exists("citations", lambda c: ~c["external"]).alias("cited")).join(full, [key, "claim"], "left")
    totals = inside.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("cited").alias("n_cited_claims"), F.count_if(F.col("cited") & F.coalesce("full", F.lit(False))).alias("n_full"))
    union = mapping.select(key, "file").unionByName(notes.select(key, "file")).distinct()
    used = judged.select(key, F.col("evidence_file").alias("file")).distinct().withColumn("used", F.lit(True))
    cover = union.join(used, [key, "file"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("evidence_total"), F.count("used").alias("evidence_used"), F.array_sort(F.collect_list(F.when(F.col("used").isNull(), F.col("file")))).alias("evidence_uncited"))
    whole = totals.join(counts, key, "left").join(cover, key, "left").na.fill(0)
    return whole.select(key, "n_claims", "n_cited_claims", "n_scored_pairs", *[x.lower() for x in LABELS], "evidence_used", "evidence_total", "evidence_uncited", rate(F.col("supportive"), F.col("n_scored_pairs")).alias("citation_precision"), rate(F.col("n_full"), F.col("n_cited_claims")).alias("claim_recall"), rate(F.col("evidence_used"), F.col("evidence_total")).alias("coverage"))


def score_synthesis(docs: DataFrame, notes: DataFrame, key: str, body: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of claims, faithfulness by key, structure by key."""
    docs, notes = materialize(docs.select(key, body), "syntheses"), materialize(notes.select(key, "file", "text"), "notes")
    scores = score_claims(cited_claims(docs, key, body), parsing.appendix(docs, key, body), notes, key, threshold)
    return scores, faithfulness(scores, key, threshold), structure(docs, notes, key, body)


def check_synthesis(docs: DataFrame, notes: DataFrame, key: str, body: str, verifier: Verifier = text.supported, labeler: Labeler | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairings and citation metrics by key."""
    docs, notes = materialize(docs.select(key, body), "syntheses"), materialize(notes.select(key, "file", "text"), "notes")
    claims, mapping = materialize(cited_claims(docs, key, body), "claims"), materialize(parsing.appendix(docs, key, body), "appendix")
    pairs = materialize(pairings(claims, mapping, notes, key, verifier, labeler), "pairs")
    return pairs, citation_metrics(claims, pairs, mapping, notes, key)


def audit(pairs: DataFrame) -> DataFrame:
    """Pairs that a reader should look at: partial, contradictory, or irrelevant though there is a file."""
    return pairs.where(F.col("label").isin(PARTIAL, CONTRADICTORY) | ((F.col("label") == IRRELEVANT) & (F.col("evidence_file") != "")))


def read_projects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Syntheses (project, body) and notes (project, file, text) under ``folder``/projects/*/literature."""
    files = spark.read.text(f"{folder}/projects/*/literature/*.md", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"projects/([^/]+)/literature/([^/]+)$", 1).alias("project"), F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))
    return files.where("file = '0_synthesis_literature.md'").select("project", F.col("text").alias("body")), files.where("file LIKE '%\\\\_evidence.md'")
