"""Queries over the supplied tables, one or more for each operator family, with their DuckDB oracles.

The supplied tables stand in for the engine's own: documents for papers, labels for triage decisions,
lineitem and orders for cost events and runs, part for model pricing, events for the event log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.operators import evaluation, evidence, graph, hypotheses, ledger, library, metrics, parsing, policy, resolve, schedule
from lumenloom.runtime import small_side

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _further() -> None:
    """The queries of the other catalogue modules."""
    from lumenloom import catalogue_acquisition, catalogue_evaluation, catalogue_evidence, catalogue_library  # noqa: F401


def queries() -> dict[str, Query]:
    _further()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _further()
    return dict(_ORACLES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id")


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


# acquisition and library


@_query("""SELECT d.source, count(*) AS seen, count(*) FILTER (l.quality = 1) AS kept, count(*) FILTER (l.quality = 1)::DOUBLE / count(*) AS rate,
           (count(*) >= 20 AND count(*) FILTER (l.quality = 1)::DOUBLE / count(*) < 0.08) AS muted
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def source_quality(spark, d):
    papers = _labelled(spark, d).withColumn("sources", F.array("source"))
    return policy.mute(policy.quality(papers, "sources", F.col("quality") == 1))


@_query("""WITH s AS (SELECT d.source, count(*) AS seen, count(*) FILTER (l.quality = 1) AS kept FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)
           SELECT source, seen, kept, kept::DOUBLE / seen AS rate, (seen >= 5 AND kept::DOUBLE / seen < 0.85) AS muted, (kept % 4)::BIGINT AS skips,
           CASE WHEN NOT (seen >= 5 AND kept::DOUBLE / seen < 0.85) THEN 'run' WHEN kept % 4 + 1 >= 4 THEN 'reprobe' ELSE 'muted_skip' END AS decision FROM s""")
def mute_decision(spark, d):
    rule = policy.Policy(min_seen=5, keep_threshold=0.85)
    papers = _labelled(spark, d).withColumn("sources", F.array("source"))
    stats = policy.mute(policy.quality(papers, "sources", F.col("quality") == 1), rule)
    return policy.decide(stats.withColumn("skips", F.col("kept") % 4), rule)


@_query("SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def project_papers_join(spark, d):
    return _labelled(spark, d).where("quality = 1").select("doc_id", "lang", "source", "quality", "toxic")


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untriaged(spark, d):
    return library.untriaged(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), ["doc_id"])


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def seen_semi(spark, d):
    return library.seen(_t(spark, d, "labels"), _t(spark, d, "documents").select("doc_id", "source"), ["doc_id"])


@_query("""SELECT DISTINCT user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-10'
           AND NOT EXISTS (SELECT 1 FROM events x WHERE x.ts < TIMESTAMP '2024-01-10' AND x.user_id = e.user_id AND x.event_type = e.event_type)""")
def link_once(spark, d):
    e = _t(spark, d, "events")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-10'")
    return resolve.link_once(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["user_id", "event_type"])


@_query("""SELECT md5(text) AS digest, min(doc_id) AS component, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def exact_dup_components(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    found = docs.groupBy("digest").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("copies"))
    return found.where("copies > 1")


@_query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/$', '') AS u,
                    coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), NULL) AS t FROM pages),
           k AS (SELECT page_id, 'u' || u AS key FROM p UNION SELECT page_id, 't' || md5(t) FROM p WHERE t IS NOT NULL),
           g AS (SELECT key, min(page_id) AS b FROM k GROUP BY key),
           e AS (SELECT DISTINCT k.page_id AS a, g.b FROM k JOIN g ON k.key = g.key),
           n AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
           , r AS (SELECT DISTINCT x.a, min(y.b) OVER (PARTITION BY x.a) AS m FROM n x JOIN n y ON x.b = y.a)
           SELECT page_id, least(page_id, (SELECT min(z.m) FROM r z JOIN n w ON z.a = w.b WHERE w.a = p.page_id), (SELECT m FROM r WHERE r.a = p.page_id LIMIT 1)) AS component FROM p""")
def identity_components(spark, d):
    pages = _t(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("address"), F.md5(F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).cast("binary")).alias("title"))
    return resolve.components(pages, "page_id", ["address", "title"])


def paper_records(spark, d):
    """Records by page: an id from the address, one from the title, an order of arrival."""
    p = _t(spark, d, "pages")
    title = F.nullif(parsing.html_title(F.col("html")), F.lit(""))
    return p.select(
        F.col("page_id").alias("seq"), F.concat(F.lit("https://doi.org/"), text.canonical_url(F.col("url"))).alias("doi"), F.concat(F.lit("arXiv:"), F.substring(F.md5(title.cast("binary")), 1, 12), F.lit("v2")).alias("arxiv_id"),
        F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("s2_id"), title.alias("title"), F.lit("").alias("abstract"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("journal"),
        F.regexp_extract(text.canonical_url(F.col("url")), "^([^/]+)", 1).alias("source"),
    )


@_query()
def paper_merge(spark, d):
    """Merged papers of the records of pages."""
    return resolve.merge_papers(paper_records(spark, d))


# ledger


@_query("SELECT l_orderkey AS run_id, count(*) AS n_events, sum(CAST(l_quantity AS DECIMAL(18,2))) AS units, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost FROM lineitem GROUP BY l_orderkey")
def run_rollup(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit(1).cast("long").alias("one"), _money("l_quantity").alias("q"), _money("l_extendedprice").alias("p"))
    return ledger.rollup(l, ["run_id"], {"n_events": "one", "units": "q", "cost": "p"})


@_query("""SELECT o.o_orderpriority AS priority, o.o_orderstatus AS status, sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS spend, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2 ORDER BY spend DESC""")
def spend_by_dim(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), _money("l_extendedprice").alias("amount"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return ledger.spend_by(l, o, ["priority", "status"], "amount")


@_query("SELECT coalesce(sum(CAST(value AS DECIMAL(18,2))), 0)::DECIMAL(38,2) AS observed FROM events WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-20 12:00:00')")
def month_to_date(spark, d):
    e = _t(spark, d, "events").withColumn("amount", _money("value"))
    return ledger.month_to_date(e, F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'"), "ts", "amount").select(F.col("observed").cast("decimal(38,2)").alias("observed"))


@_query("""WITH m AS (SELECT date_trunc('month', ts)::TIMESTAMP AS window_start, sum(CAST(value AS DECIMAL(18,2)))::DECIMAL(38,2) AS observed FROM events GROUP BY 1)
           SELECT window_start, observed, 20000 AS cap, 16000 AS warn, CASE WHEN observed >= 20000 THEN 'hard_stop' WHEN observed >= 16000 THEN 'warning' END AS tripped,
           observed < 20000 AS ok, observed::DOUBLE / 20000 AS utilization FROM m""")
def budget_gate(spark, d):
    months = _t(spark, d, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("window_start")).agg(F.sum(_money("value")).cast("decimal(38,2)").alias("observed"))
    return ledger.budget_state(months, 20000, 80)


@_query("""WITH y AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, sum(CAST(value AS DECIMAL(18,2))) AS spent FROM events GROUP BY 1),
           r AS (SELECT day, date_trunc('month', day)::TIMESTAMP AS window_start, sum(spent) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS observed FROM y),
           c AS (SELECT t.threshold, r.* FROM r, (VALUES ('warning', 1000.0), ('hard_stop', 5000.0)) t(threshold, cap) WHERE r.observed >= t.cap)
           SELECT threshold, window_start, min(day) AS opened_at, arg_min(observed, day)::DOUBLE AS observed FROM c GROUP BY threshold, window_start""")
def incident_open_once(spark, d):
    e = _t(spark, d, "events").select("ts", _money("value").alias("amount"))
    found = ledger.running_incidents(e, "ts", "amount", {"warning": 1000.0, "hard_stop": 5000.0})
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("threshold", stamp("window_start"), stamp("opened_at"), F.col("observed").cast("double").alias("observed"))


@_query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def last_n_runs(spark, d):
    return ledger.last_runs(_t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 25, "o_orderdate", "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' AND o_orderstatus = 'F' ORDER BY place LIMIT 25")
def digest_delta(spark, d):
    o = _t(spark, d, "orders").where((F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '2000-01-01'")) & (F.col("o_orderstatus") == "F"))
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)  # the digest shows 25
    return top.select("o_orderkey", "o_totalprice", F.rank().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@_query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return ledger.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@_query("""SELECT l.l_orderkey AS run_id, sum(CAST(coalesce(l.l_quantity * p.p_retailprice + l.l_quantity * 0.5 * p.p_retailprice * 1.25 + 2 * l.l_quantity * p.p_size + l.l_linenumber * p.p_retailprice, 0) AS DECIMAL(28,5))) AS microcents
           FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size < 40 GROUP BY 1""")
def token_cost(spark, d):
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    p = _t(spark, d, "part").where("p_size < 40").select("p_partkey", "p_retailprice", "p_size")
    joined = l.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    q, rate = F.col("l_quantity"), F.col("p_retailprice")
    cost = ledger.cents(q, F.col("l_linenumber"), 2 * q, q * 0.5, rate, rate, F.col("p_size"))
    return joined.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum((cost * 1_000_000).cast("decimal(28,5)")).alias("microcents"))


@_query("""WITH s AS (SELECT l_suppkey AS model, round(1000 * (sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / count(*)), 2) AS cost_per_1k, round(10 * (sum(CAST(l_discount AS DECIMAL(18,2)))::DOUBLE / count(*)), 4) AS f1 FROM lineitem GROUP BY 1),
           n AS (SELECT *, f1 >= max(f1) OVER () - 0.05 AS near_best FROM s), c AS (SELECT min(cost_per_1k) FILTER (near_best) AS least, arg_max(cost_per_1k, (f1, -model)) AS best_cost FROM n)
           SELECT model, cost_per_1k, f1, near_best, cost_per_1k = least AS cheapest, round(1 - least / best_cost, 6) AS saving FROM n, c""")
def cost_per_1k(spark, d):
    l = _t(spark, d, "lineitem")
    s = l.groupBy(F.col("l_suppkey").alias("model")).agg(F.round(1000 * (F.sum(_money("l_extendedprice")).cast("double") / F.count(F.lit(1))), 2).alias("cost_per_1k"), F.round(10 * (F.sum(_money("l_discount")).cast("double") / F.count(F.lit(1))), 4).alias("f1"))
    return evaluation.cheapest_near_best(s, "model", "cost_per_1k", "f1").withColumn("saving", F.round("saving", 6))


@_query("""SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS least, max(l_quantity) AS greatest, max(l_quantity) - min(l_quantity) AS range FROM lineitem GROUP BY 1""")
def run_variance(spark, d):
    found = metrics.spread(_t(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


# metrics

_CONFUSION = """SELECT {k} count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn,
                count(*) FILTER (quality = 0 AND n_chars < 500) AS tn, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@_query(f"""WITH c AS ({_CONFUSION.format(k="")}) SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM c""")
def confusion_prf(spark, d):
    counts = _labelled(spark, d).agg(*metrics.confusion(F.col("quality") == 1, F.col("n_chars") >= 500))
    return counts.select("*", *metrics.prf())


@_query(f"""WITH c AS ({_CONFUSION.format(k="d.source,")} GROUP BY d.source),
            f AS (SELECT coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c),
            s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c)
            SELECT 'micro' AS scope, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM s
            UNION ALL SELECT 'macro', avg(p), avg(r), avg(f) FROM f""")
def prf_micro_macro(spark, d):
    counts = _labelled(spark, d).groupBy("source").agg(*metrics.confusion(F.col("quality") == 1, F.col("n_chars") >= 500))
    return metrics.micro_macro(counts, ["source"])


@_query("""WITH c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic)::DOUBLE AS s, sum(quality)::DOUBLE AS q, sum(toxic)::DOUBLE AS t FROM labels),
           p AS (SELECT n, s / n AS po, (q * t + (n - q) * (n - t)) / (n * n) AS pe FROM c)
           SELECT n::BIGINT AS n, po, pe, (po - pe) / (1 - pe) AS kappa FROM p""")
def cohen_kappa(spark, d):
    return metrics.kappa(_t(spark, d, "labels"), "quality", "toxic")


@_query("SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def direction_confusion(spark, d):
    p = evaluation.direction_confusion(_t(spark, d, "labels"), "quality", "toxic").groupBy("quality").pivot("toxic", [0, 1]).agg(F.first("n"))
    return p.select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@_query("""WITH s AS (SELECT d.source, count(*) AS n, avg(l.quality::DOUBLE) AS share FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1) SELECT source, n, share, 2 * share / (share + 1) AS f1 FROM s""")
def keep_all_baseline(spark, d):
    s = _labelled(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("quality").cast("double")).alias("share"))
    return s.withColumn("f1", metrics.keep_all_f1(F.col("share")))


@_query()
def bootstrap_ci(spark, d):
    return metrics.bootstrap_groups(_labelled(spark, d), "source", "quality")


@_query()
def bipartite_match(spark, d):
    """Number matching between the numbers of a document's first and second half."""
    docs = _t(spark, d, "documents").where(F.col("text").rlike("[0-9]"))
    half = F.floor(F.length("text") / 2).cast("int")
    found = lambda x: F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    rows = docs.select("doc_id", F.transform(found(F.substring("text", F.lit(1), half)), lambda g: F.array(g)).alias("gold"), found(F.substring("text", half + 1, F.length("text"))).alias("found"))
    return metrics.match_groups(rows, ["doc_id"], "gold", "found", lambda a, b: a in b or b in a)


@_query("""SELECT DISTINCT lower(regexp_replace(b.text, '\\s+', ' ', 'g')) <> '' AS asked, b.item_id, count(d.doc_id) AS n_documents, count(d.doc_id) > 0 AS covered
           FROM benchmark b LEFT JOIN documents d ON contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY b.item_id, b.text""")
def coverage_sets(spark, d):
    b = _t(spark, d, "benchmark")
    hits = evidence.quoted(b.select("item_id", F.col("text").alias("quote")), _t(spark, d, "documents").select("doc_id", "text"), "quote", "text", "doc_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    n = F.coalesce("n_documents", F.lit(0))
    return b.join(hits, "item_id", "left").select((text.squeeze(F.col("text")) != "").alias("asked"), "item_id", n.alias("n_documents"), (n > 0).alias("covered"))


# text


@_query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/$', '') AS address,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/$', ''), '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM pages""")
def url_canonical(spark, d):
    address = text.canonical_url(F.col("url"))
    return _t(spark, d, "pages").select("page_id", address.alias("address"), text.safe_id(address).alias("safe"))


@_query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS w, trim(regexp_replace(regexp_replace(lower(trim(source || ' ' || lang)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents)
           SELECT doc_id, slug, len(w) AS n_tokens, coalesce(list_aggregate(w, 'min'), '') AS first_token, coalesce(list_aggregate(w, 'max'), '') AS last_token FROM t""")
def norm_text(spark, d):
    w = text.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"), F.size(w).cast("long").alias("n_tokens"), F.coalesce(F.array_min(w), F.lit("")).alias("first_token"), F.coalesce(F.array_max(w), F.lit("")).alias("last_token"))


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
           r AS (SELECT doc_id, line, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS raw FROM l),
           t AS (SELECT *, starts_with(raw, '|') OR length(raw) - length(replace(raw, '|', '')) >= 2 AS is_row FROM r WHERE raw <> ''),
           c AS (SELECT doc_id, line, CASE WHEN is_row THEN CASE WHEN regexp_matches(raw, '^[\\s|:\\-]+$') THEN [] ELSE list_filter([array_to_string(list_filter(list_transform(string_split(regexp_replace(raw, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: trim(x)), lambda x: x <> ''), ' · ')], lambda x: x <> '') END
                 ELSE list_filter(list_transform(string_split(regexp_replace(raw, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') END AS cs FROM t)
           SELECT doc_id, count(*) AS n_lines, sum(len(cs))::BIGINT AS n_clauses, sum(list_sum(list_transform(cs, lambda x: length(x))))::BIGINT AS n_chars FROM c WHERE len(cs) > 0 GROUP BY doc_id""")
def clause_explode(spark, d):
    found = parsing.clauses(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count_distinct("line").alias("n_lines"), F.count(F.lit(1)).alias("n_clauses"), F.sum(F.length("clause")).alias("n_chars"))


@_query()
def nuggets(spark, d):
    return parsing.nuggets(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@_query("SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')), ' ') AS numbers FROM documents WHERE regexp_matches(text, '\\d')")
def numbers_extract(spark, d):
    return _t(spark, d, "documents").where(F.col("text").rlike(r"\d")).select("doc_id", F.array_join(text.numbers(F.col("text")), " ").alias("numbers"))


@_query()
def standalone_numbers(spark, d):
    return _t(spark, d, "documents").where(F.col("text").rlike(r"\d")).select("doc_id", F.array_join(text.standalone_numbers(F.col("text")), " ").alias("numbers"))


@_query("""WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 800 THEN [text] ELSE list_transform(range(0, length(text), 680), lambda i: substr(text, i + 1, 800)) END AS cs FROM documents WHERE text IS NOT NULL),
           p AS (SELECT doc_id, list_filter(cs, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS cs FROM c)
           SELECT doc_id, pos, md5(passage) AS digest, length(passage)::BIGINT AS n FROM (SELECT doc_id, unnest(cs) AS passage, unnest(range(len(cs))) AS pos FROM p)""")
def chunks(spark, d):
    found = evidence.passages(_t(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("passage").cast("binary")).alias("digest"), F.length("passage").cast("long").alias("n"))


_LEXICON = ("the", "und", "que", "tion", "license", "password", "stupid")


@_query(f"""SELECT d.doc_id, t.term FROM documents d, (VALUES {", ".join(f"('{t}')" for t in _LEXICON)}) t(term) WHERE regexp_matches(lower(d.text), '(^|[^a-z0-9])' || t.term || '([^a-z0-9]|$)')""")
def dictionary_ner(spark, d):
    found = evaluation.dictionary_entities(_t(spark, d, "documents"), "doc_id", "text", {"word": _LEXICON})
    return found.select("doc_id", F.col("norm").alias("term"))


@_query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, d):
    return _t(spark, d, "pages").select("page_id", parsing.html_title(F.col("html")).alias("title"))


@_query("""SELECT event_type, json_type(props) IS NOT NULL AS valid, count(*) AS n, count(DISTINCT props) AS n_props FROM events GROUP BY 1, 2""")
def json_props(spark, d):
    parsed = F.from_json(parsing.loose_json(F.col("props")), "map<string,string>")
    return _t(spark, d, "events").groupBy("event_type", parsed.isNotNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("props").alias("n_props"))


@_query("SELECT event_id, ts FROM events WHERE minute(ts) IN (0, 15, 30, 45) AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_ticks(spark, d):
    return _t(spark, d, "events").select("event_id", "ts").where(schedule.matches("*/15 8-17 * * mon-fri", F.col("ts")))


# evidence

_CONTENT = "list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) >= 3)), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"


@_query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) WHERE trim(b.text) <> ''""")
def quote_in_source(spark, d):
    quotes = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return evidence.quoted(quotes, _t(spark, d, "documents").select("doc_id", "text"), "quote", "text", "doc_id").select("item_id", "doc_id")


@_query(f"""WITH b AS (SELECT item_id, text, {_CONTENT.format(c="text")} AS w FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT doc_id, text, {_CONTENT.format(c="text")} AS w FROM documents)
            SELECT b.item_id, d.doc_id, len(list_intersect(b.w, d.w)) AS shared, coalesce(len(list_intersect(b.w, d.w))::DOUBLE / nullif(len(b.w), 0), 0) >= 0.5 AS ok FROM b, d WHERE len(list_intersect(b.w, d.w)) > 0""")
def overlap_verify(spark, d):
    """All documents, for the benchmark items whose id is divisible by 50: texts meet claims by shared words only."""
    b = _t(spark, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("claim"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    words = lambda df, key, c: df.select(key, F.explode(text.content_words(F.col(c))).alias("word"))
    shared = words(docs, "doc_id", "text").join(small_side(words(b, "item_id", "claim")), "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    pairs = docs.join(shared, "doc_id").join(small_side(b), "item_id")
    return evidence.verify(pairs, "claim", "text").select("item_id", "doc_id", "shared", "ok")


_TOK1 = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@_query(f"""WITH b AS (SELECT item_id, {_TOK1.format(c="text")} AS w FROM benchmark WHERE item_id % 50 = 0),
            s AS (SELECT doc_id, {_TOK1.format(c="s")} AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM documents))
            SELECT b.item_id, s.doc_id, round(max(coalesce(2.0::DOUBLE * len(list_intersect(b.w, s.w)) / nullif(len(b.w) + len(s.w), 0), 0)), 3) AS score FROM b, s GROUP BY 1, 2""")
def token_f1_best_sentence(spark, d):
    """Whole documents of any length, for the benchmark items whose id is divisible by 50."""
    b = _t(spark, d, "benchmark").where("item_id % 50 = 0").select("item_id", text.tokens(F.col("text"), 1).alias("words"))
    docs = _t(spark, d, "documents").select("doc_id", evidence.sentence_tokens(F.col("text")).alias("sentences"))  # a document is taken apart once, whatever the number of items
    return docs.join(small_side(b, evidence.QUERY_ROWS), F.lit(True)).select("item_id", "doc_id", evidence.best_f1_of(F.col("words"), F.col("sentences")).alias("score"))


@_query("""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3))) AS w FROM documents),
           c AS (SELECT w, min(doc_id) AS class_id, len(w) AS n FROM t WHERE len(w) > 0 GROUP BY w),
           e AS MATERIALIZED (SELECT class_id, n, unnest(w) AS token FROM c),
           p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM e x JOIN e y ON x.token = y.token AND x.class_id < y.class_id
                 WHERE x.n > 0.85 * y.n AND y.n > 0.85 * x.n GROUP BY x.class_id, y.class_id HAVING s > 0.85),
           l AS (SELECT class_id, count(*) AS n_links, max(s) AS similarity FROM (SELECT a AS class_id, s FROM p UNION ALL SELECT b, s FROM p) GROUP BY class_id)
           SELECT t.doc_id, coalesce(c.class_id, t.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, round(similarity, 6) AS similarity FROM t LEFT JOIN c ON t.w = c.w AND len(t.w) > 0 LEFT JOIN l ON c.class_id = l.class_id""")
def near_dup_jaccard(spark, d):
    """All documents by class of equal tokens, with the classes that each is like, by the measure of the duplicate filter."""
    found = evidence.similar_documents(_t(spark, d, "documents"), "doc_id", "text", hypotheses.Config().token_jaccard_dup)
    return found.withColumn("similarity", F.round("similarity", 6))


_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@_query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_COSINE} AS c FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
            SELECT query_id, item_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, item_id) AS rank FROM s QUALIFY rank <= 3""")
def retrieve_topk(spark, d):
    """Every row whose id is divisible by 50 as a query, against all rows."""
    e = _t(spark, d, "embeddings")
    found = evidence.top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 3)
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@_query(f"""WITH s AS (SELECT a.vec_id AS q, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
            f AS (SELECT q, min(rank) FILTER (hit) AS first FROM s GROUP BY q)
            SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_k FROM f""")
def mrr_recall_at_k(spark, d):
    e = _t(spark, d, "embeddings")
    first = evidence.first_hits(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", "label")
    return metrics.reciprocal_ranks(first, "first", 10).withColumn("mrr", F.round("mrr", 9))


@_query(f"""WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 800 THEN [text] ELSE list_transform(range(0, length(text), 680), lambda i: substr(text, i + 1, 800)) END AS cs FROM documents),
            p AS (SELECT doc_id, unnest(cs) AS passage, unnest(range(len(cs))) AS pos FROM c), w AS (SELECT doc_id, pos, {_CONTENT.format(c="passage")} AS w FROM p WHERE trim(passage) <> ''),
            b AS (SELECT item_id, {_CONTENT.format(c="text")} AS w FROM benchmark WHERE item_id % 50 = 0)
            SELECT b.item_id, w.doc_id, w.pos, len(list_intersect(b.w, w.w)) AS shared FROM b, w QUALIFY row_number() OVER (PARTITION BY b.item_id, w.doc_id ORDER BY len(list_intersect(b.w, w.w)) DESC, w.pos) = 1""")
def best_passage(spark, d):
    """All documents, for the benchmark items whose id is divisible by 50."""
    docs = _t(spark, d, "documents")
    b = _t(spark, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("claim"))
    asked = docs.select("doc_id").join(small_side(b, evidence.QUERY_ROWS), F.lit(True))
    found = evidence.best_passage(asked, evidence.passages(docs, "doc_id", "text"), "item_id", "claim", ["doc_id"])
    return found.select("item_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.col("shared").cast("long").alias("shared"))


@_query("""WITH t AS (SELECT conv_id, role, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations), e AS (SELECT DISTINCT conv_id, role, unnest(w) AS token FROM t), f AS (SELECT * FROM e WHERE length(token) >= 3),
           g AS (SELECT conv_id, token, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM f GROUP BY 1, 2),
           s AS (SELECT conv_id, count(*) FILTER (u) AS n_user, count(*) FILTER (a) AS n_assistant, count(*) FILTER (u AND a) AS shared FROM g GROUP BY 1)
           SELECT conv_id, n_user, n_assistant, shared, shared::DOUBLE / nullif(n_user, 0) AS recall, (n_assistant - shared)::DOUBLE / nullif(n_assistant, 0) AS extra FROM s""")
def entity_recall(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "role", F.explode(text.tokens(F.col("text"))).alias("token"))
    g = c.groupBy("conv_id", "token").agg(F.bool_or(F.col("role") == "user").alias("u"), F.bool_or(F.col("role") == "assistant").alias("a"))
    s = g.groupBy("conv_id").agg(F.count_if("u").alias("n_user"), F.count_if("a").alias("n_assistant"), F.count_if(F.col("u") & F.col("a")).alias("shared"))
    return s.select("*", metrics.ratio(F.col("shared"), F.col("n_user"), None).alias("recall"), metrics.ratio(F.col("n_assistant") - F.col("shared"), F.col("n_assistant"), None).alias("extra"))


# graph


@_query("""WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
           up AS (SELECT c AS node, p AS ancestor, 1 AS distance FROM t UNION ALL SELECT up.node, t.p, up.distance + 1 FROM up JOIN t ON up.ancestor = t.c)
           SELECT node, ancestor, min(distance) AS distance FROM up GROUP BY 1, 2""")
def cell_hierarchy_closure(spark, d):
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("c"), F.concat(F.lit("r"), "n_regionkey").alias("p"))
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("c"), F.lit("world").alias("p"))
    return graph.ancestors(n.unionByName(r), "c", "p")


@_query("""WITH a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS mid FROM lineitem WHERE l_discount >= 0.09), b AS (SELECT p_partkey AS mid, p_brand || ' ' || p_size AS dst FROM part),
           k AS (SELECT DISTINCT l.l_suppkey AS src, p.p_brand || ' ' || p.p_size AS dst FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R')
           SELECT DISTINCT a.src, a.mid, b.dst FROM a JOIN b ON a.mid = b.mid WHERE (a.src, b.dst) NOT IN (SELECT src, dst FROM k)""")
def motif_two_hop(spark, d):
    l, p = _t(spark, d, "lineitem"), _t(spark, d, "part").withColumn("state", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")))
    first = l.where("l_discount >= 0.09").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    second = p.select(F.col("p_partkey").alias("src"), F.col("state").alias("dst"))
    known = l.where("l_returnflag = 'R'").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("src"), F.col("state").alias("dst"))
    return graph.two_hop(first, second, known)


_SIGNED = """WITH m AS (SELECT avg(CAST(value AS DECIMAL(18,2)))::DOUBLE AS m FROM events), e AS (SELECT user_id AS dst, event_type AS src, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / count(*) AS v FROM events GROUP BY 1, 2), s AS (SELECT src, dst, sign(v - m)::INT AS sign FROM e, m)"""


@_query(f"""{_SIGNED} SELECT a.dst, a.src AS a_src, b.src AS b_src, b.sign FROM s a JOIN s b ON a.dst = b.dst AND a.sign = -b.sign WHERE a.src = 'click' AND b.src <> 'click' AND a.sign <> 0""")
def motif_opposite_sign(spark, d):
    e = _t(spark, d, "events").withColumn("amount", _money("value"))
    mean = e.agg(F.avg("amount").cast("double").alias("m"))
    each = e.groupBy(F.col("event_type").alias("src"), F.col("user_id").alias("dst")).agg((F.sum("amount").cast("double") / F.count(F.lit(1))).alias("v"))
    signed = each.crossJoin(F.broadcast(mean)).select("src", "dst", F.signum(F.col("v") - F.col("m")).cast("int").alias("sign"))  # one row
    return graph.opposite(signed.where("src = 'click'"), signed.where("src <> 'click'"))


@_query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_discount > 0.05 THEN 1 WHEN l_discount < 0.05 THEN -1 ELSE 0 END AS sign, l_quantity AS confidence, l_orderkey * 10 + l_linenumber AS edge_id FROM lineitem),
           b AS (SELECT e.src, p.p_brand AS set, e.dst, arg_max(sign, (confidence, -edge_id)) AS sign FROM e JOIN part p ON e.dst = p.p_partkey WHERE sign <> 0 GROUP BY 1, 2, 3),
           c AS (SELECT src, set, count(*) AS n, count(*) FILTER (sign > 0) AS up FROM b GROUP BY 1, 2)
           SELECT src, set, n, up, CASE WHEN up::DOUBLE / n >= 0.5 THEN 'increase' ELSE 'decrease' END AS direction, CASE WHEN up::DOUBLE / n >= 0.5 THEN up ELSE n - up END AS support FROM c WHERE n >= 3 AND greatest(up::DOUBLE / n, 1 - up::DOUBLE / n) >= 0.7""")
def motif_consolidation(spark, d):
    sign = F.when(F.col("l_discount") > 0.05, 1).when(F.col("l_discount") < 0.05, -1).otherwise(0)
    e = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), sign.alias("sign"), F.col("l_quantity").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"))
    members = _t(spark, d, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("set"))
    return graph.consolidate(e, members)


@_query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem), n AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)
           SELECT node, out_degree, in_degree, out_degree > 0 AND in_degree > 0 AS pivot FROM n""")
def graph_pivots(spark, d):
    return graph.nodes(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@_query("""SELECT CASE WHEN c.c_custkey IS NULL THEN 'missing_support_frame' WHEN o_orderstatus = 'P' THEN 'ungrounded_support' WHEN c_acctbal < 0 THEN 'incompatible_context' WHEN o_totalprice < 5000 THEN 'unknown_direction'
           WHEN c_mktsegment = 'BUILDING' THEN 'no_named_readout' ELSE 'kept' END AS reason, count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def filter_cascade_reasons(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    checks = [
        ("missing_support_frame", F.col("c_custkey").isNull()), ("ungrounded_support", F.col("o_orderstatus") == "P"), ("incompatible_context", F.col("c_acctbal") < 0),
        ("unknown_direction", F.col("o_totalprice") < 5000), ("no_named_readout", F.col("c_mktsegment") == "BUILDING"),
    ]
    return graph.reasons(rows, checks)


@_query()
def rank_with_caps(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return graph.rank_with_caps(p, [F.desc("p_retailprice"), F.col("p_partkey")], "p_brand", "p_type", 5, 10, 100)
