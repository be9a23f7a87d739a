"""Queries of synthesis reports, evidence records, frames, the evidence graph and hypotheses, on texts made of the supplied tables.

The SQL derives what must come out from the columns that the texts are made of; the library reads the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.catalogue import _query, _t
from lumenloom.functions.text import STOP_WORDS
from lumenloom.operators import frames, grounding, hypotheses, parsing, synthesis
from lumenloom.runtime import materialize

# syntheses: a line a part, an author each, notes of every other part

_AUTHORS = ("Adams", "Baker", "Clark", "Davis", "Evans", "Frank")
_LINES = f"""p AS (SELECT p_partkey AS k, p_brand AS project, p_size AS size, p_size % 30 AS cd, lower(p_type) AS kind, ({list(_AUTHORS)})[p_partkey % 6 + 1] AS author, CASE WHEN p_partkey % 11 = 0 THEN 'none' WHEN p_partkey % 13 = 0 THEN 'external' ELSE 'author' END AS cite FROM part),
c AS (SELECT *, 'Part ' || k || ' shows ' || size || '% of CD' || cd || ' signal in ' || kind || '.' AS claim FROM p),
n AS (SELECT project, author, k, size, cd, claim FROM c WHERE k % 2 = 0 AND author NOT IN ('Evans', 'Frank'))"""


def _lines(spark, d):
    p = _t(spark, d, "part")
    author = F.element_at(F.array(*map(F.lit, _AUTHORS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(" shows "), F.col("p_size").cast("string"), F.lit("% of CD"), (F.col("p_size") % 30).cast("string"), F.lit(" signal in "), F.lower("p_type"))
    mark = F.when(F.col("p_partkey") % 11 == 0, "").when(F.col("p_partkey") % 13 == 0, " [External Review]").otherwise(F.concat(F.lit(" ["), author, F.lit(" 2021]")))
    return p.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("k"), author.alias("author"), F.concat(text, F.lit(".")).alias("claim"), F.concat(text, mark, F.lit(".")).alias("line"))


def _syntheses(spark, d):
    """(docs, notes): project and body; project, file and text. Evans's file is empty, Frank has no entry."""
    lines = _lines(spark, d)
    table = "\n".join(f"| [{a} 2021] | `{a.lower()}_evidence.md` |" for a in _AUTHORS[:-1])
    body = F.concat(F.lit("---\nproject: x\n---\n# Synthesis\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n"), F.lit("\n\n## Appendix A\n" + table + "\n"))
    docs = lines.groupBy("project").agg(body.alias("body"))
    kept = F.when((F.col("k") % 2 == 0) & ~F.col("author").isin("Evans", "Frank"), F.struct("k", "claim"))
    notes = lines.where("author <> 'Frank'").groupBy("project", "author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["claim"]), "\n").alias("text"))
    return docs, notes.select("project", F.concat(F.lower("author"), F.lit("_evidence.md")).alias("file"), "text")


_TOK1 = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
_SCORED = f"""{_LINES},
j AS (SELECT c.project, c.k, c.size, c.cd, c.claim, n.size AS nsize, n.cd AS ncd, n.k AS nk, {_TOK1.format(c="c.claim")} AS a, {_TOK1.format(c="n.claim")} AS b FROM c JOIN n ON c.project = n.project AND c.author = n.author WHERE c.cite = 'author'),
s AS (SELECT project, k, bool_or(size = nsize) AND bool_or(k IN (nk, nsize, ncd)) AND bool_or(cd IN (nk, nsize, ncd)) AS num, bool_or(contains('cd' || ncd, 'cd' || cd)) AS ent, round(max(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b))), 3) AS lex FROM j GROUP BY 1, 2)"""


@_query(f"""WITH {_SCORED} SELECT project, count(*) AS n_scored_claims, round(avg((num AND ent AND lex >= 0.3)::INT), 3) AS faithfulness_rate, round(avg(num::INT), 3) AS number_grounded_rate, round(avg(ent::INT), 3) AS entity_grounded_rate,
            round(avg((lex >= 0.3)::INT), 3) AS lexical_overlap_rate FROM s GROUP BY 1""")
def synthesis_faithfulness(spark, d):
    docs, notes = _syntheses(spark, d)
    return synthesis.score_synthesis(docs, notes, "project", "body")[1]


@_query(f"""WITH {_SCORED} SELECT s.project, replace(c.claim, '.', ' .') AS claim, num AS number_grounded, ent AS entity_grounded, lex AS lexical_overlap, num AND ent AND lex >= 0.3 AS passed FROM s JOIN c ON s.project = c.project AND s.k = c.k""")
def synthesis_claims(spark, d):
    docs, notes = _syntheses(spark, d)
    return synthesis.score_synthesis(docs, notes, "project", "body")[0].select("project", "claim", "number_grounded", "entity_grounded", "lexical_overlap", "passed")


@_query(f"""WITH {_LINES}, f AS (SELECT DISTINCT project, author FROM n), u AS (SELECT DISTINCT project, author FROM c WHERE cite = 'author'),
            v AS (SELECT f.project, count(*) AS total, count(u.author) AS used FROM f LEFT JOIN u ON f.project = u.project AND f.author = u.author GROUP BY 1),
            m AS (SELECT c.project, count(*) AS clauses, count(*) FILTER (cite = 'none') AS uncited, count(*) FILTER (cite = 'author') AS markers, count(*) FILTER (cite = 'author' AND f.author IS NULL) AS dangling FROM c LEFT JOIN f ON c.project = f.project AND c.author = f.author GROUP BY 1)
            SELECT m.project, clauses AS n_clauses, markers AS n_cited_claims, uncited AS n_uncited_claims, markers AS n_citation_markers, dangling AS n_dangling, coalesce(v.used, 0) AS evidence_used, coalesce(v.total, 0) AS evidence_total,
            round(uncited::DOUBLE / clauses, 3) AS uncited_claim_rate, round(dangling::DOUBLE / nullif(markers, 0), 3) AS dangling_rate, round(v.used::DOUBLE / v.total, 3) AS coverage FROM m LEFT JOIN v ON m.project = v.project""")
def synthesis_structure(spark, d):
    docs, notes = _syntheses(spark, d)
    return synthesis.structure(docs, notes, "project", "body").drop("evidence_uncited", "count_consistent")


_WORDS = "list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) >= 3)), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"


@_query(f"""WITH {_LINES}, e AS (SELECT project, author, string_agg(claim, chr(10) ORDER BY k) AS t FROM n GROUP BY 1, 2),
            r AS (SELECT c.project, c.claim, c.author, {_WORDS.format(c="c.claim")} AS w, e.t, len(list_intersect({_WORDS.format(c="c.claim")}, {_WORDS.format(c="e.t")})) AS hits, contains(e.t, c.k::VARCHAR) AND contains(e.t, c.size::VARCHAR) AS stated FROM c JOIN e ON c.project = e.project AND c.author = e.author WHERE c.cite = 'author'),
            q AS (SELECT project, count(*) AS n_scored_pairs, count(*) FILTER (hits::DOUBLE / len(w) >= 0.5 AND stated) AS supportive FROM r GROUP BY 1),
            t AS (SELECT project, count(*) FILTER (cite <> 'none') AS n_claims, count(*) FILTER (cite = 'author') AS n_cited_claims FROM c GROUP BY 1),
            f AS (SELECT DISTINCT project, author FROM c WHERE author <> 'Frank'), v AS (SELECT f.project, count(*) AS evidence_total, count(r.author) AS evidence_used FROM (SELECT DISTINCT project, unnest({list(_AUTHORS[:-1])}) AS author FROM c) f LEFT JOIN (SELECT DISTINCT project, author FROM r) r ON f.project = r.project AND f.author = r.author GROUP BY 1)
            SELECT t.project, n_claims, n_cited_claims, coalesce(n_scored_pairs, 0) AS n_scored_pairs, coalesce(supportive, 0) AS supportive, round(supportive::DOUBLE / n_scored_pairs, 3) AS citation_precision, round(coalesce(supportive, 0)::DOUBLE / nullif(n_cited_claims, 0), 3) AS claim_recall, evidence_used, evidence_total, round(evidence_used::DOUBLE / evidence_total, 3) AS coverage
            FROM t LEFT JOIN q ON t.project = q.project LEFT JOIN v ON t.project = v.project""")
def citation_metrics(spark, d):
    docs, notes = _syntheses(spark, d)
    found = synthesis.check_synthesis(docs, notes, "project", "body")[1]
    return found.select("project", "n_claims", "n_cited_claims", "n_scored_pairs", "supportive", "citation_precision", "claim_recall", "evidence_used", "evidence_total", "coverage")


@_query(f"WITH {_LINES} SELECT project, replace(claim, '.', ' .') AS claim, CASE cite WHEN 'external' THEN '[External Review]' ELSE '[' || author || ' 2021]' END AS raw, CASE cite WHEN 'external' THEN '' ELSE lower(author) END AS key FROM c WHERE cite <> 'none'")
def cited_claims(spark, d):
    docs, _ = _syntheses(spark, d)
    return synthesis.cited_claims(docs, "project", "body").select("project", "claim", F.inline("citations")).select("project", "claim", "raw", "key")


@_query(f"SELECT p_brand AS project, lower(a) AS citation, lower(a) || '_evidence.md' AS file FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest({list(_AUTHORS[:-1])}) AS a)")
def appendix_entries(spark, d):
    docs, _ = _syntheses(spark, d)
    return parsing.appendix(docs, "project", "body").select("project", "citation", "file")


@_query("""SELECT p_partkey AS k, 'Here are ' || n || ' markers: CD1, CD2 and CD3.' AS claim, n::BIGINT AS claimed, 3::BIGINT AS listed, n = 3 AS ok FROM (SELECT p_partkey, p_size % 4 + 1 AS n FROM part)""")
def count_checks(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("Here are "), (F.col("p_size") % 4 + 1).cast("string"), F.lit(" markers: CD1, CD2 and CD3.")).alias("clause"))
    return synthesis.count_checks(p, "k")


# evidence records

_RECORDS_SQL = """r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 5, 30) WHEN 1 THEN translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN '' ELSE 'not in this text 0123456' END AS q FROM documents)"""


def _records(spark, d):
    docs = _t(spark, d, "documents")
    n = F.col("doc_id") % 4
    part = F.substring("text", 5, 30)
    quote = F.when(n == 0, part).when(n == 1, F.translate(part, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(n == 2, "").otherwise("not in this text 0123456")
    number = (F.col("doc_id") % 7).cast("string")
    return docs.select(
        F.col("doc_id").cast("string").alias("paper_id"), F.when(n == 3, "odd").otherwise("HIGH").alias("relevance"), F.array(F.struct(F.lit("CD4").alias("symbol"), F.lit(None).cast("string").alias("species"), quote.alias("source_quote"))).alias("genes"),
        F.array(F.struct(F.lit("T cell").alias("cell_type"), F.when(n == 2, "high").otherwise(number).alias("value"), F.lit("%").alias("unit"), quote.alias("source_quote"))).alias("frequencies"),
        F.array(F.struct(F.when(n != 1, F.lit("a statement")).alias("statement"), quote.alias("source_quote"))).alias("findings"),
    )


@_query(f"""WITH {_RECORDS_SQL}, g AS (SELECT d.doc_id, trim(regexp_replace(r.q, '\\s+', ' ', 'g')) <> '' AND contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(r.q, '\\s+', ' ', 'g')))) AS ok FROM documents d JOIN r ON d.doc_id = r.doc_id)
            SELECT f AS field, count(*) FILTER (ok) AS grounded, count(*) FILTER (NOT ok) AS flagged, CASE f WHEN 'genes' THEN 0 WHEN 'findings' THEN count(*) ELSE count(*) FILTER (doc_id % 4 <> 2) END AS value_checked FROM g, (SELECT unnest(['genes', 'frequencies', 'findings']) AS f) GROUP BY f""")
def quote_grounding(spark, d):
    sources = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    return grounding.counts(grounding.by_quote(grounding.items(_records(spark, d)), sources), ["field"])


@_query("""SELECT doc_id::VARCHAR AS paper_id, f.field, CASE f.field WHEN 'genes' THEN 'CD4' WHEN 'frequencies' THEN 'T cell ' || CASE WHEN doc_id % 4 = 2 THEN 'high' ELSE (doc_id % 7)::VARCHAR END || ' %' ELSE CASE WHEN doc_id % 4 <> 1 THEN 'a statement' ELSE '' END END AS claim,
           f.field = 'findings' OR (f.field = 'frequencies' AND doc_id % 4 <> 2) AS strict FROM documents, (SELECT unnest(['genes', 'frequencies', 'findings']) AS field) f""")
def evidence_items(spark, d):
    return grounding.items(_records(spark, d)).select("paper_id", "field", "claim", "strict")


@_query("SELECT doc_id::VARCHAR AS paper_id, ((doc_id % 4 = 3)::INT + (doc_id % 4 = 1)::INT)::INT AS n_errors FROM documents")
def record_problems(spark, d):
    return grounding.problems(_records(spark, d)).select("paper_id", F.size("errors").alias("n_errors"))


@_query("""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'NOT_USEFUL' ELSE 'MODERATE' END AS relevance, p_brand AS species, p_size % 2 = 0 AS has_gene, p_size % 5 = 0 AS has_marker, CASE WHEN p_size % 2 = 0 THEN 'seen GZMB here' END AS quote FROM part""")
def stub_records(spark, d):
    p = _t(spark, d, "part")
    said = F.when(F.col("p_partkey") % 3 == 0, "High relevance").when(F.col("p_partkey") % 3 == 1, "not useful, low").otherwise("moderate")
    md = F.concat(F.lit("---\nrelevance: "), said, F.lit("\nspecies: ["), F.col("p_brand"), F.lit("]\ncell_types:\n  - T cell (naive)\n---\nNote"), F.when(F.col("p_size") % 2 == 0, " of GZMB,").otherwise(" of xGZMB,"), F.when(F.col("p_size") % 5 == 0, " CD44 and cd44").otherwise(""))
    notes = p.select(F.col("p_partkey").alias("paper_id"), md.alias("text"))
    sources = p.select(F.col("p_partkey").alias("paper_id"), F.lit("seen  GZMB here").alias("text"))
    found = grounding.stub_records(notes, sources)
    first = lambda c, k: F.try_element_at(c, F.lit(1))[k] if k else F.try_element_at(c, F.lit(1))
    return found.select(F.col("paper_id").alias("k"), "relevance", first(F.col("species"), None).alias("species"), (F.size("genes") > 0).alias("has_gene"), (F.size("surface_markers") == 1).alias("has_marker"), first(F.col("genes"), "source_quote").alias("quote"))


@_query(f"""WITH c AS (SELECT role AS mode, text AS passage, substr(text, 1, 60) AS claim, turn % 2 = 0 AS gold FROM conversations), w AS (SELECT *, {_WORDS.format(c="claim")} AS a, {_WORDS.format(c="passage")} AS b FROM c),
            v AS (SELECT mode, (len(a) > 0 AND len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1) >= 0.5) = gold AS ok FROM w)
            SELECT mode, count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (ok)::DOUBLE / count(*) AS accuracy FROM v GROUP BY ROLLUP (mode)""")
def battery_accuracy(spark, d):
    c = _t(spark, d, "conversations")
    cases = c.select(F.col("role").alias("mode"), F.col("text").alias("passage"), F.substring("text", 1, 60).alias("claim"), (F.col("turn") % 2 == 0).alias("gold"))
    return grounding.score_battery(cases)


# findings: a part each, seven kinds of statement

_GENES, _ACTS, _CELLS = ("FOXP3", "GZMB", "CD14"), ("IFN-beta", "LPS"), ("Tregs", "NK cells")
_F = f"""f AS (SELECT 'p' || (p_partkey % 100) AS paper_id, p_partkey AS k, (row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_partkey) - 1)::INT AS idx, p_size % 7 AS kind, ({list(_GENES)})[p_partkey % 3 + 1] AS gene, ({list(_ACTS)})[p_partkey // 3 % 2 + 1] AS act,
         (['regulatory T cell', 'NK cell'])[p_partkey // 7 % 2 + 1] AS cell FROM part)"""


def _findings(spark, d):
    """Records: one a hundredth of the parts, with one finding a part."""
    p = _t(spark, d, "part")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    k, kind = F.col("p_partkey"), F.col("p_size") % 7
    gene, act, cell = pick(_GENES, k % 3), pick(_ACTS, F.floor(k / 3) % 2), pick(_CELLS, F.floor(k / 7) % 2)
    say = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    said = (
        F.when(kind == 0, say(act, " increased ", gene, " in ", cell)).when(kind == 1, say(act, " reduced ", gene, " in ", cell)).when(kind == 2, say(gene, " was higher in COVID-19 patients in ", cell)).when(kind == 3, say(gene, " marks ", cell))
        .when(kind == 4, say(act, " did not increase ", gene, " in ", cell)).when(kind == 5, F.lit("the cohort was described")).otherwise(say(gene, " was lower than expected in severe cases compared with healthy controls"))
    )
    rows = p.select(F.concat(F.lit("p"), (k % 100).cast("string")).alias("paper_id"), k.alias("k"), said.alias("statement"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "statement"))), lambda x: F.struct(x["statement"].alias("statement"), x["statement"].alias("source_quote")))
    named = lambda field, names, *more: F.array(*[F.struct(F.lit(n).alias(field), *[F.lit(v).alias(m) for m, v in more], F.lit("").alias("source_quote")) for n in names])
    return rows.groupBy("paper_id").agg(listed.alias("findings")).select(
        "paper_id", F.lit("HIGH").alias("relevance"), F.array(F.lit("Homo sapiens")).alias("species"), F.array(F.lit("PBMC")).alias("tissue"), named("symbol", _GENES, ("species", "human")).alias("genes"), named("name", _ACTS).alias("perturbations"),
        named("name", ("regulatory T cell", "NK cell")).alias("cell_types"), named("name", ("covid",)).alias("diseases"), named("marker", ("CD25",), ("maps_to_gene", "")).alias("surface_markers"),
        F.array().cast("array<struct<name:string,genes:array<string>,species:string,source_quote:string>>").alias("signatures"), "findings",
    )


@_query(f"""WITH {_F} SELECT paper_id, idx, gene AS readout, CASE kind WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' WHEN 2 THEN 'association_positive' WHEN 3 THEN 'unknown' WHEN 4 THEN 'no_change' ELSE 'association_negative' END AS direction,
            CASE WHEN kind IN (0, 1, 4) THEN 'interventional' WHEN kind = 3 THEN 'descriptive_marker' ELSE 'case_control' END AS evidence_mode, CASE WHEN kind <> 6 THEN cell END AS cell, CASE WHEN kind IN (0, 1, 4) THEN act WHEN kind = 2 THEN 'COVID-19' END AS anchor,
            CASE WHEN kind = 6 THEN 'healthy controls' END AS comparator, CASE WHEN kind = 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence,
            CASE kind WHEN 0 THEN 'The paper reports that ' || act || ' increased ' || gene || ' expression in ' || cell || '.' WHEN 1 THEN 'The paper reports that ' || act || ' decreased ' || gene || ' expression in ' || cell || '.' WHEN 2 THEN 'The paper reports that COVID-19 was associated with higher ' || gene || ' expression in ' || cell || '.'
            WHEN 3 THEN 'The paper reports that ' || gene || ' marks ' || cell || '.' WHEN 4 THEN 'The paper reports that ' || act || ' did not change ' || gene || ' expression in ' || cell || '.' ELSE 'The paper reports that the disease condition was associated with lower ' || gene || ' expression compared with healthy controls.' END AS atomic_claim
            FROM f WHERE kind <> 5""")
def finding_frames(spark, d):
    found = frames.frames(frames.read_findings(_findings(spark, d)))
    return found.select("paper_id", "idx", F.col("readout.name").alias("readout"), "direction", "evidence_mode", F.col("cell.name").alias("cell"), F.col("anchor.name").alias("anchor"), "context.comparator", F.col("parser_confidence").alias("confidence"), "atomic_claim")


@_query(f"WITH {_F} SELECT 'missing_readout' AS reason, count(*) AS n FROM f WHERE kind = 5")
def findings_skipped(spark, d):
    return frames.skipped(frames.read_findings(_findings(spark, d))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_E = f"""{_F}, i AS (SELECT *, 'GENE_RNA:human:' || lower(gene) AS g, 'PERTURBATION:na:' || replace(lower(act), '-', '_') AS a, 'CELL_TYPE:human:' || replace(lower(cell), ' ', '_') AS c FROM f),
e AS (SELECT paper_id, idx, cell, CASE kind WHEN 2 THEN 'DISEASE:na:covid_19' WHEN 3 THEN g ELSE a END AS src, CASE kind WHEN 3 THEN c ELSE g END AS dst, CASE kind WHEN 0 THEN 'INCREASES_READOUT' WHEN 1 THEN 'DECREASES_READOUT' WHEN 2 THEN 'ASSOCIATED_WITH_HIGHER_READOUT' ELSE 'DEFINES_OR_MARKS' END AS relation,
     CASE kind WHEN 1 THEN -1 WHEN 3 THEN 0 ELSE 1 END AS sign, kind FROM i WHERE kind < 4)"""


def _edges(spark, d):
    return materialize(frames.edges(frames.ground(frames.frames(frames.read_findings(_findings(spark, d))), frames.entailed)), "edges")


@_query(f"WITH {_E} SELECT src, dst, relation, sign, count(*) AS n, count(DISTINCT paper_id) AS papers FROM e GROUP BY ALL")
def evidence_edges(spark, d):
    return _edges(spark, d).groupBy("src", "dst", "relation", "sign").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("papers"))


@_query(f"WITH {_E} SELECT DISTINCT x AS node, split_part(x, ':', 1) AS type FROM (SELECT src AS x FROM e UNION SELECT dst FROM e)")
def evidence_nodes(spark, d):
    return frames.nodes(_edges(spark, d)).select("node", "type")


@_query(f"""WITH {_E}, p AS (SELECT DISTINCT src, dst, cell, sign FROM e WHERE kind IN (0, 1)), m AS (SELECT DISTINCT src, dst, cell FROM e WHERE kind = 3), s AS (SELECT DISTINCT dst, cell FROM e WHERE kind = 2)
            SELECT 'perturbation_to_marker_state_completion' AS motif, p.src AS anchor, p.dst AS readouts, CASE WHEN sign > 0 THEN 'increase' ELSE 'decrease' END AS direction, p.cell FROM p JOIN m ON p.dst = m.src AND p.cell = m.cell
            UNION SELECT 'disease_signature_reversal', p.src, p.dst, 'decrease', p.cell FROM p JOIN s ON p.dst = s.dst AND p.cell = s.cell WHERE p.sign < 0
            UNION SELECT 'cite_seq_marker_bridge', src, dst || ',SURFACE_PROTEIN:human:cd14', CASE WHEN sign > 0 THEN 'increase' ELSE 'decrease' END, cell FROM p WHERE dst = 'GENE_RNA:human:cd14'""")
def hypothesis_candidates(spark, d):
    records = _findings(spark, d)
    found = hypotheses.generate(_edges(spark, d), frames.signature_index(records))
    return found.select("motif", F.col("anchor_id").alias("anchor"), F.array_join("readout_ids", ",").alias("readouts"), "direction", "cell")


@_query()
def hypotheses_ranked(spark, d):
    """The whole run, from records to ranked candidates; held against a worked example in the tests."""
    found = hypotheses.run(_findings(spark, d)).candidates
    return found.select("rank", "hypothesis_id", "motif", "claim", "rank_score", F.size("papers").alias("n_papers"))


_CONTEXTS = ("regulatory T cell", "CD4 T cells", "NK cell", "odd cell", "")


@_query(f"""WITH p AS (SELECT p_partkey AS k, p_size % 2 AS s, p_size % 5 AS a, p_partkey % 5 AS b, p_size % 3 AS t FROM part), x AS (SELECT *, CASE s WHEN 0 THEN 1.0 ELSE 0.8 END AS species,
            CASE WHEN a = 4 OR b = 4 THEN 0.8 WHEN a = b THEN 1.0 WHEN a < 3 AND b < 3 THEN CASE WHEN a + b = 1 THEN 0.6 END WHEN a < 3 OR b < 3 THEN 0.8 ELSE 0.4 END AS cell, CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 END AS tissue FROM p)
            SELECT k, species IS NOT NULL AND cell IS NOT NULL AND tissue IS NOT NULL AS ok, coalesce(round(species * cell * tissue, 3), 0)::DOUBLE AS score FROM x""")
def context_compatibility(spark, d):
    p = _t(spark, d, "part")
    names = F.array(*map(F.lit, _CONTEXTS))
    none = F.array().cast("array<string>")
    listed = lambda x: F.when(x == "", none).otherwise(F.array(x))
    word = lambda x: F.lit(x)

    def made(species, cell, tissue):
        return F.struct(species.alias("species"), tissue.alias("tissue"), none.alias("disease"), listed(cell).alias("cell_type"), none.alias("perturbation"), F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("comparator"), F.lit(None).cast("string").alias("timepoint"))

    a = made(F.array(word("human")), F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")), F.array(word("blood")))
    t = F.col("p_size") % 3
    b = made(F.when(F.col("p_size") % 2 == 0, F.array(word("Human"))).otherwise(none), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")), F.when(t == 0, F.array(word(" blood."))).when(t == 1, none).otherwise(F.array(word("lung"))))
    rows = p.select(F.col("p_partkey").alias("k"), a.alias("a"), b.alias("b"))
    m = hypotheses.compatible(F.col("a"), F.col("b"))
    return rows.select("k", m["ok"].alias("ok"), m["score"].alias("score"))
