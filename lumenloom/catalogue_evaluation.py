"""Queries of evaluations, identifiers and model answers over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom import control
from lumenloom.catalogue import _LEXICON, _query, _t
from lumenloom.functions import text
from lumenloom.operators import evaluation, synthesis


@_query("""WITH a AS (SELECT d.source AS backend, CASE WHEN l.quality = 1 THEN 'RELEVANT' WHEN l.toxic = 1 THEN 'BORDERLINE' ELSE 'NOT_RELEVANT' END AS gold, CASE d.n_chars % 5 WHEN 0 THEN 'NOT_RELEVANT' WHEN 1 THEN 'BORDERLINE' WHEN 4 THEN 'UNKNOWN' ELSE 'RELEVANT' END AS said, d.n_chars % 1000 AS ms FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
           c AS (SELECT backend, count(*) FILTER (gold <> 'NOT_RELEVANT' AND said IN ('RELEVANT', 'BORDERLINE')) AS tp, count(*) FILTER (gold = 'NOT_RELEVANT' AND said IN ('RELEVANT', 'BORDERLINE')) AS fp, count(*) FILTER (gold <> 'NOT_RELEVANT' AND said NOT IN ('RELEVANT', 'BORDERLINE')) AS fn, count(*) AS n,
                 count(*) FILTER (gold = said) AS correct3, count(*) FILTER (said = 'UNKNOWN') AS unknown, sum(ms)::BIGINT AS ms FROM a GROUP BY 1)
           SELECT backend, n, tp, fp, fn, correct3, unknown, correct3::DOUBLE / n AS acc3, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (ms // n)::BIGINT AS avg_ms FROM c""")
def triage_pooled(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    n = F.col("n_chars") % 5
    gold = F.when(F.col("quality") == 1, "RELEVANT").when(F.col("toxic") == 1, "BORDERLINE").otherwise("NOT_RELEVANT")
    said = F.when(n == 0, "NOT_RELEVANT").when(n == 1, "BORDERLINE").when(n != 4, "RELEVANT")
    answers = rows.select(F.col("source").alias("backend"), gold.alias("gold"), said.alias("predicted"), (F.col("n_chars") % 1000).alias("latency_ms"), F.lit(0.0).alias("cost_cents"))
    return evaluation.triage_scores(answers).select("backend", "n", "tp", "fp", "fn", "correct3", "unknown", "acc3", "precision", "recall", "f1", "avg_ms")


_EX = """r AS (SELECT p_partkey AS k, list_distinct(['a' || (p_partkey % 5), 'b' || (p_size % 7)]) AS found, list_distinct(['a' || (p_size % 5), 'b' || (p_size % 7)]) AS gold, p_partkey % 10 <> 0 AS mined FROM part),
c AS (SELECT f.field, sum(CASE WHEN mined THEN len(list_intersect(found, gold)) ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN mined THEN len(found) ELSE 0 END)::BIGINT AS np, sum(len(gold))::BIGINT AS ng FROM r, (SELECT unnest(['genes', 'cell_types']) AS field) f GROUP BY 1),
s AS (SELECT field, tp, np - tp AS fp, ng - tp AS fn, tp::DOUBLE / np AS precision, tp::DOUBLE / ng AS recall, 2.0::DOUBLE * tp / (np + ng) AS f1 FROM c)"""


@_query(f"""WITH {_EX} SELECT 'strict' AS tier, 'field' AS scope, field, precision, recall, f1 FROM s
            UNION ALL SELECT 'strict', 'micro', NULL, sum(tp)::DOUBLE / sum(tp + fp), sum(tp)::DOUBLE / sum(tp + fn), 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) FROM s UNION ALL SELECT 'strict', 'macro', NULL, avg(precision), avg(recall), avg(f1) FROM s""")
def extraction_report(spark, d):
    """Records of parts against a key that labels genes and cell types; a tenth of the papers was not mined."""
    p = _t(spark, d, "part")
    name = lambda x, c, n: F.concat(F.lit(x), (F.col(c) % n).cast("string"))
    item = lambda field, *xs: F.array(*[F.struct(x.alias(field)) for x in xs])
    found = (name("A", "p_partkey", 5), name(" b", "p_size", 7))
    records = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("paper_id"), item("symbol", *found).alias("genes"), item("name", *found).alias("cell_types"))
    values = F.array_distinct(F.array(name("a", "p_size", 5), name("b", "p_size", 7)))
    gold = p.select(F.col("p_partkey").alias("paper_id"), F.explode(F.array(F.lit("genes"), F.lit("cell_types"))).alias("field"), values.alias("values"))
    return evaluation.extraction_report(evaluation.extraction_scores(records, gold, ["strict"])).select("tier", "scope", "field", "precision", "recall", "f1")


_HIT = "regexp_matches(lower({c}), '(^|[^a-z0-9])' || t.term || '([^a-z0-9]|$)')"


@_query(f"""WITH t AS (SELECT unnest({list(_LEXICON)}) AS term), c AS (SELECT conv_id, string_agg(text, chr(10)) FILTER (role = 'user') AS u, string_agg(text, chr(10)) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1),
            x AS (SELECT conv_id, t.term, coalesce({_HIT.format(c="u")}, false) AS s, coalesce({_HIT.format(c="a")}, false) AS m, contains(lower(coalesce(u, '')), t.term) AS inside FROM c, t),
            g AS (SELECT conv_id, count(*) FILTER (s) AS n_silver, count(*) FILTER (m) AS n_mine, count(*) FILTER (s AND m) AS hits, count(*) FILTER (m AND NOT s AND NOT inside) AS extra FROM x GROUP BY 1)
            SELECT conv_id, n_silver::INT AS n_silver, n_mine::INT AS n_mine, round(hits::DOUBLE / nullif(n_silver, 0), 3) AS recall, round(extra::DOUBLE / nullif(n_mine, 0), 3) AS extra_rate FROM g""")
def entity_recall_dictionary(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(F.when(F.col("role") == "user", F.col("text"))), "\n").alias("text"), F.array_join(F.collect_list(F.when(F.col("role") == "assistant", F.col("text"))), "\n").alias("note"))
    words = {"word": _LEXICON}
    silver, mined = evaluation.dictionary_entities(c, "conv_id", "text", words), evaluation.dictionary_entities(c, "conv_id", "note", words)
    return evaluation.entity_recall(silver, mined, c, "conv_id", ["word"]).select("conv_id", "n_silver", "n_mine", "recall", "extra_rate")


@_query("""WITH r AS (SELECT l_suppkey % 5 AS model, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS recall, l_tax AS faithfulness, CASE l_returnflag WHEN 'A' THEN 'BENEFIT' WHEN 'N' THEN 'HARM' ELSE 'MIXED' END AS g, CASE l_linestatus WHEN 'F' THEN 'BENEFIT' ELSE 'HARM' END AS c FROM lineitem),
           m AS (SELECT model, count(*) AS n, avg(recall) AS recall, avg(faithfulness) AS faithfulness, count(*) FILTER (g = c)::DOUBLE / count(*) AS dir_acc FROM r GROUP BY 1),
           p AS (SELECT model, l, sum((g = l)::INT)::DOUBLE AS a, sum((c = l)::INT)::DOUBLE AS b, count(*)::DOUBLE AS n FROM r, (SELECT unnest(['BENEFIT', 'HARM', 'MIXED']) AS l) GROUP BY 1, 2), e AS (SELECT model, sum(a * b / (n * n)) AS pe FROM p GROUP BY 1)
           SELECT m.model, n, round(recall, 9) AS recall, round(faithfulness, 9) AS faithfulness, round(dir_acc, 9) AS dir_acc, round((dir_acc - pe) / (1 - pe), 9) AS kappa FROM m JOIN e ON m.model = e.model""")
def model_summary(spark, d):
    l = _t(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    rows = l.select(
        (F.col("l_suppkey") % 5).alias("model"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("recall"), F.col("l_tax").alias("faithfulness"), F.lit(None).cast("double").alias("f1"), F.lit(None).cast("double").alias("precision_gold"),
        F.when(flag == "A", "BENEFIT").when(flag == "N", "HARM").otherwise("MIXED").alias("gold_dir"), F.when(F.col("l_linestatus") == "F", "BENEFIT").otherwise("HARM").alias("cand_dir"),
    )
    found = evaluation.model_summary(rows, "model")
    return found.select("model", "n", *[F.round(c, 9).alias(c) for c in ("recall", "faithfulness", "dir_acc", "kappa")])


@_query("SELECT p_partkey AS config, round(200 * p_retailprice + 30 * p_size + 1.6, 6) AS total, round(52 * (200 * p_retailprice + 30 * p_size + 1.6), 6) AS yearly FROM part")
def cost_projection(spark, d):
    configs = _t(spark, d, "part").select(F.col("p_partkey").alias("config"), F.col("p_retailprice").alias("triage"), F.col("p_size").cast("double").alias("mine"), F.lit(1.6).alias("synth"))
    return evaluation.project_cost(configs).select("config", F.round("total", 6).alias("total"), F.round("yearly", 6).alias("yearly"))


@_query("SELECT event_type AS provider, count(*) AS calls, sum(user_id)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens, (sum(event_id % 1000) // count(*))::BIGINT AS avg_ms FROM events GROUP BY 1")
def provider_tallies(spark, d):
    zero = F.lit(0).cast("long")
    calls = _t(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("user_id").alias("input_tokens"), zero.alias("cached_tokens"), zero.alias("creation_tokens"), (F.col("event_id") % 100).alias("output_tokens"), zero.alias("cost_cents"), (F.col("event_id") % 1000).alias("latency_ms"))
    return evaluation.provider_tallies(calls).select("provider", "calls", "input_tokens", "output_tokens", "avg_ms")


_W = "list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) >= 3)), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"
_SENT = "list_filter(list_transform(string_split(regexp_replace(trim(coalesce({c}, '')), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: length(s) >= 15)"


@_query(f"""WITH c AS (SELECT conv_id, max(text) FILTER (turn = 0) AS gold, max(text) FILTER (turn = 1) AS cand, max(text) FILTER (turn = 2) AS src FROM conversations GROUP BY 1), s AS (SELECT *, {_SENT.format(c="gold")} AS g, {_SENT.format(c="cand")} AS k FROM c),
            x AS (SELECT conv_id, g, k, len(g)::INT AS n_gold, len(k)::INT AS n_cand, len(list_filter(g, lambda z: len({_W.format(c="z")}) > 0 AND len(list_intersect({_W.format(c="z")}, {_W.format(c="cand")}))::DOUBLE / greatest(len({_W.format(c="z")}), 1) >= 0.5)) AS hit, len(list_filter(k, lambda z: len({_W.format(c="z")}) > 0 AND len(list_intersect({_W.format(c="z")}, {_W.format(c="coalesce(src, '')")}))::DOUBLE / greatest(len({_W.format(c="z")}), 1) >= 0.5)) AS held, src, cand FROM s)
            SELECT conv_id, n_gold, n_cand, CASE WHEN n_gold = 0 THEN NULL WHEN trim(coalesce(cand, '')) = '' THEN 0 ELSE hit::DOUBLE / n_gold END AS recall, CASE WHEN src IS NULL OR n_cand = 0 THEN NULL WHEN trim(src) = '' THEN 0 ELSE held::DOUBLE / n_cand END AS faithfulness FROM x""")
def summary_coverage(spark, d):
    """Turns of conversations as gold, candidate and source; their texts state no numbers."""
    at = lambda k, n: F.max(F.when(F.col("turn") == k, F.col("text"))).alias(n)
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(at(0, "gold"), at(1, "cand"), at(2, "src"))
    return evaluation.coverage(rows, "gold", "cand", "src").select("conv_id", "n_gold", "n_cand", "recall", "faithfulness")


@_query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def sample_first(spark, d):
    return evaluation.take_sample(_t(spark, d, "documents").select("doc_id", "n_chars"), 50, "doc_id")


# identifiers and answers


@_query("""SELECT page_id, nullif('10.1/' || page_id, '') AS doi, 'a' || page_id AS arxiv_id, CASE page_id % 3 WHEN 0 THEN 'doi:10.1/' || page_id WHEN 1 THEN 'arxiv:a' || page_id ELSE 'pmid:' || page_id END AS paper, 'x_' || page_id || '_gamma' AS slug,
           'GENE:na:x_' || page_id AS entity FROM pages""")
def identifiers(spark, d):
    p = _t(spark, d, "pages")
    n = F.col("page_id").cast("string")
    doi, arxiv = text.norm_doi(F.concat(F.lit(" HTTPS://dx.doi.org/10.1/"), n)), text.norm_arxiv(F.concat(F.lit("arXiv:A"), n, F.lit("v12")))
    k = F.col("page_id") % 3
    none = F.lit(None).cast("string")
    paper = text.canonical_id(F.when(k == 0, doi).otherwise(none), F.when(k <= 1, arxiv).otherwise(none), n, none)
    return p.select("page_id", doi.alias("doi"), arxiv.alias("arxiv_id"), paper.alias("paper"), text.slug(text.fold_greek(F.concat(F.lit("X "), n, F.lit(" --γ!")))).alias("slug"), text.entity_id(F.lit("GENE"), F.lit(""), F.concat(F.lit("x "), n)).alias("entity"))


@_query("""SELECT doc_id, CASE quality WHEN 1 THEN 'RELEVANT' ELSE CASE toxic WHEN 1 THEN 'NOT_RELEVANT' ELSE 'BORDERLINE' END END AS label, CASE WHEN doc_id % 2 = 0 THEN 0.75 WHEN quality = 1 THEN 0.8 WHEN toxic = 1 THEN 0.1 ELSE 0.5 END::DOUBLE AS score, CASE doc_id % 3 WHEN 0 THEN 'NO_DIFFERENCE' WHEN 1 THEN 'HARM' ELSE 'UNKNOWN' END AS direction FROM labels""")
def model_answers(spark, d):
    l = _t(spark, d, "labels")
    said = F.concat(F.when(F.col("quality") == 1, "**Relevant**").when(F.col("toxic") == 1, "Not relevant:").otherwise("I say borderline"), F.when(F.col("doc_id") % 2 == 0, " 0.75 because").otherwise(" because"))
    turn = F.when(F.col("doc_id") % 3 == 0, "No clear difference.").when(F.col("doc_id") % 3 == 1, "Overall it is a clear harm").otherwise("?")
    label = text.parse_label(said)
    return l.select("doc_id", label.alias("label"), text.parse_score(said, label).alias("score"), evaluation.parse_direction(turn).alias("direction"))


@_query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN p_size % 2 = 0 WHEN 2 THEN false ELSE true END AS same FROM part""")
def quantity_matches(spark, d):
    p = _t(spark, d, "part")
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    a = F.when(k == 0, F.concat(F.lit("at least "), n, F.lit(" mg"))).when(k == 1, F.concat(n, F.lit("%"))).when(k == 2, F.concat(n, F.lit(" mg"))).otherwise(F.lit("high dose"))
    b = F.when(k == 0, F.concat(F.lit("≥"), n, F.lit("mg"))).when(k == 1, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("about "), n, F.lit(" %"))).otherwise(n)).when(k == 2, F.concat(F.lit("> "), n, F.lit(" mg"))).otherwise(F.lit("dose high"))
    return p.select(F.col("p_partkey").alias("k"), text.number_match(a, b).alias("same"))


@_query("SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN ['cd25', 'il2ra'] WHEN 1 THEN ['foxp3', 'scurfin'] ELSE ['zz' || p_partkey] END AS names, ['FOXP3', 'CITE-seq', 'IL' || p_partkey || 'RA'] AS entities FROM part")
def gene_aliases(spark, d):
    p = _t(spark, d, "part")
    n = F.col("p_partkey").cast("string")
    symbol = F.when(F.col("p_size") % 3 == 0, "CD25.").when(F.col("p_size") % 3 == 1, " FOXP3").otherwise(F.concat(F.lit("ZZ"), n))
    claim = F.concat(F.lit("DNA of FOXP3 by CITE-seq, foxp3 FOXP3 and IL"), n, F.lit("RA with RNA"))
    return p.select(F.col("p_partkey").alias("k"), F.array_sort(synthesis.aliases(symbol)).alias("names"), synthesis.entities(claim).alias("entities"))


@_query("SELECT max(o_orderdate) FILTER (o_orderstatus = 'F')::TIMESTAMP AS since FROM orders")
def previous_digest(spark, d):
    o = _t(spark, d, "orders")
    files = o.select(F.concat(F.when(F.col("o_orderstatus") == "F", "weekly").otherwise("other"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("Z.md")).alias("file"))
    return control.previous_digest(files, "weekly").select(F.col("since").cast("timestamp_ntz").alias("since"))
