"""Queries of the library, the ledger and their schemas over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom import schemas
from lumenloom.catalogue import _money, _query, _t
from lumenloom.operators import ledger, library

_START = "TIMESTAMP_NTZ '2024-01-01'"
#: Links and papers made of documents and labels.
_LINKS = """(SELECT coalesce(d.source, 'none') AS project, d.doc_id::VARCHAR AS paper_id, CASE l.quality WHEN 1 THEN 'RELEVANT' WHEN 0 THEN 'NOT_RELEVANT' END AS triage_label, (d.n_chars % 100)::DOUBLE / 100 AS triage_score,
             CASE l.quality WHEN 1 THEN 'kept' WHEN 0 THEN 'dropped' ELSE 'screened' END AS status, d.doc_id, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS acquired_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_PAPERS = "(SELECT doc_id::VARCHAR AS paper_id, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'fetched' ELSE 'open' END AS pdf_status, n_chars FROM documents)"


def _links(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return docs.select(
        F.coalesce("source", F.lit("none")).alias("project"), F.col("doc_id").cast("string").alias("paper_id"), F.when(q == 1, "RELEVANT").when(q == 0, "NOT_RELEVANT").alias("triage_label"), ((F.col("n_chars") % 100).cast("double") / 100).alias("triage_score"),
        F.lit(None).cast("string").alias("triage_model"), F.when(q == 1, "kept").when(q == 0, "dropped").otherwise("screened").alias("status"), (F.expr(_START) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("acquired_at"), F.lit(None).cast("timestamp_ntz").alias("decided_at"),
    )


def _papers(spark, d):
    n = F.col("doc_id") % 4
    state = F.when(n == 0, "none").when(n == 1, "unavailable").when(n == 2, "fetched").otherwise("open")
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), state.alias("pdf_status"), F.lit(None).cast("string").alias("pdf_path"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), "n_chars")


@_query(f"SELECT l.project, l.paper_id, l.triage_label, l.triage_score, l.status AS proj_status, p.pdf_status FROM {_LINKS} l JOIN {_PAPERS} p ON l.paper_id = p.paper_id WHERE l.status = 'kept'")
def library_of_projects(spark, d):
    return library.of_project(_links(spark, d), _papers(spark, d), None, "kept").select("project", "paper_id", "triage_label", "triage_score", "proj_status", "pdf_status")


@_query(f"SELECT l.project, l.paper_id FROM {_LINKS} l JOIN {_PAPERS} p ON l.paper_id = p.paper_id WHERE l.status = 'kept' AND p.pdf_status IN ('none', 'unavailable')")
def pdf_pending(spark, d):
    return library.pdf_pending(_links(spark, d), _papers(spark, d)).select("project", "paper_id")


@_query("SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM documents) AS project_links")
def library_counts(spark, d):
    return library.counts(_papers(spark, d), _links(spark, d))


_MERGED = "(SELECT doc_id::VARCHAR AS paper_id, (min(doc_id) OVER (PARTITION BY text))::VARCHAR AS survivor, doc_id AS place FROM documents QUALIFY doc_id > min(doc_id) OVER (PARTITION BY text))"


def _merged(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("s"))
    return docs.join(least, "h").where("doc_id > s").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("s").cast("string").alias("survivor"), F.col("doc_id").alias("place"))


@_query(f"""SELECT l.project, coalesce(m.survivor, l.paper_id) AS paper_id, l.status, l.triage_score FROM {_LINKS} l LEFT JOIN {_MERGED} m ON l.paper_id = m.paper_id
            QUALIFY row_number() OVER (PARTITION BY l.project, coalesce(m.survivor, l.paper_id) ORDER BY coalesce(m.place, -1), l.paper_id) = 1""")
def links_after_merge(spark, d):
    return library.relink(_links(spark, d), _merged(spark, d)).select("project", "paper_id", "status", "triage_score")


@_query("SELECT min(doc_id)::VARCHAR AS paper_id FROM documents GROUP BY text")
def papers_after_merge(spark, d):
    return library.without(_papers(spark, d), _merged(spark, d)).select("paper_id")


@_query(f"""SELECT l.project, l.paper_id, CASE WHEN x.doc_id IS NOT NULL THEN CASE WHEN x.toxic = 1 THEN 'NOT_RELEVANT' ELSE 'BORDERLINE' END ELSE l.triage_label END AS triage_label,
            CASE WHEN x.doc_id IS NOT NULL THEN CASE WHEN x.toxic = 1 THEN 0.1 END ELSE l.triage_score END AS triage_score, CASE WHEN x.toxic = 1 THEN 'dropped' ELSE l.status END AS status, x.doc_id IS NOT NULL AS decided
            FROM {_LINKS} l LEFT JOIN labels x ON l.doc_id = x.doc_id""")
def triage_update(spark, d):
    bad = F.col("toxic") == 1
    side = _t(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("project")).join(_t(spark, d, "labels"), "doc_id")
    made = side.select("project", F.col("doc_id").cast("string").alias("paper_id"), F.when(bad, "NOT_RELEVANT").otherwise("BORDERLINE").alias("label"), F.when(bad, 0.1).alias("score"), F.lit("rule").alias("model"), F.when(bad, "dropped").alias("status"))
    done = library.set_triage(_links(spark, d), made, F.expr(_START))
    return done.select("project", "paper_id", "triage_label", "triage_score", "status", F.col("decided_at").isNotNull().alias("decided"))


@_query(f"SELECT p.paper_id, CASE WHEN p.n_chars % 10 = 0 THEN CASE WHEN p.n_chars % 20 = 0 THEN 'fetched' ELSE 'unavailable' END ELSE p.pdf_status END AS pdf_status, CASE WHEN p.n_chars % 20 = 0 THEN '/pdf/' || p.paper_id END AS pdf_path FROM {_PAPERS} p")
def pdf_update(spark, d):
    p = _papers(spark, d)
    found = F.col("n_chars") % 20 == 0
    files = p.where("n_chars % 10 = 0").select("paper_id", F.when(found, F.concat(F.lit("/pdf/"), "paper_id")).alias("path"), F.when(~found, "unavailable").alias("status"))
    return library.set_pdf(p, files, F.expr(_START)).select("paper_id", "pdf_status", "pdf_path")


@_query(f"SELECT paper_id, project, triage_score, row_number() OVER (ORDER BY triage_score DESC, paper_id) AS place FROM {_LINKS} WHERE status = 'kept' AND acquired_at > TIMESTAMP '2024-01-01 00:30:00' ORDER BY place LIMIT 25")
def digest_new(spark, d):
    return library.new_since(_links(spark, d), _papers(spark, d), None, F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00'")).select("paper_id", "project", "triage_score", "place")


@_query("""WITH p AS (SELECT page_id, md5(url) AS doi, CASE WHEN page_id % 3 = 0 THEN md5(html) END AS pmid FROM pages), w AS (SELECT page_id AS k, doi, pmid FROM p WHERE page_id % 50 = 0)
           SELECT k, p.page_id::VARCHAR AS paper_id, min(CASE WHEN w.doi = p.doi THEN 0 ELSE 2 END)::INT AS strength FROM w JOIN p ON w.doi = p.doi OR w.pmid = p.pmid GROUP BY 1, 2""")
def paper_lookup(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("paper_id"), F.md5(F.col("url").cast("binary")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.when(F.col("page_id") % 3 == 0, F.md5(F.col("html").cast("binary"))).alias("pmid"), F.lit(None).cast("string").alias("s2_id"))
    return library.lookup(p, p.where("page_id % 50 = 0").withColumnRenamed("page_id", "k"), "k")


# ledger


def _runs(spark, d):
    o = _t(spark, d, "orders")
    new = o.select(F.col("o_custkey").cast("string").alias("project"), F.col("o_orderpriority").alias("routine"), F.lit(None).cast("string").alias("invocation"), F.col("o_orderkey").cast("string").alias("id"))
    return schemas.conform(ledger.start_runs(new, F.expr("TIMESTAMP '2024-01-01 00:00:00'")), "runs")


@_query("""SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS routine, 'manual' AS invocation, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
           CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 9)::INT ELSE 0 END AS papers_new, CASE WHEN o_orderstatus = 'P' THEN 'late' END AS error, o_orderstatus IN ('F', 'P') AS finished FROM orders""")
def runs_lifecycle(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus IN ('F', 'P')")
    failed = F.col("o_orderstatus") == "P"
    done = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(failed, "failed").alias("status"), F.when(failed, "late").alias("error"), F.when(~failed, (F.col("o_orderkey") % 9).cast("int")).alias("papers_new"))
    rows = ledger.finish_runs(_runs(spark, d), done, F.expr("TIMESTAMP '2024-01-02 00:00:00'"))
    return rows.select("id", "routine", "invocation", "status", "papers_new", "error", F.col("finished_at").isNotNull().alias("finished"))


def _events(spark, d):
    l = _t(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cached_input_tokens"), F.round(F.col("l_extendedprice") * 100).alias("cost_cents"), F.col("l_shipdate").alias("occurred_at"))


@_query("""SELECT o_orderkey::VARCHAR AS id, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS input_tokens, coalesce(sum(l_linenumber), 0)::BIGINT AS output_tokens, coalesce(sum(round(l_extendedprice * 100)), 0)::DOUBLE AS cost_cents
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def run_totals(spark, d):
    return ledger.run_totals(_runs(spark, d), _events(spark, d)).select("id", "input_tokens", "output_tokens", "cost_cents")


@_query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT -1) SELECT k::VARCHAR AS id, coalesce((SELECT sum(round(l_extendedprice * 100)) FROM lineitem WHERE l_orderkey = k), 0)::DOUBLE AS cost_cents FROM a""")
def run_cost(spark, d):
    totals = ledger.run_totals(_runs(spark, d), _events(spark, d))
    asked = _t(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("string").alias("id")).unionByName(spark.createDataFrame([("-1",)], "id string"))
    return ledger.run_cost(totals, asked)


@_query("SELECT l_linestatus AS model, l_returnflag AS phase, sum(round(l_extendedprice * 100)) AS spend, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def spend_by_model_and_phase(spark, d):
    return ledger.spend_by(_events(spark, d), None, ["model", "phase"], "cost_cents", F.expr("TIMESTAMP_NTZ '1998-01-01'"))


@_query("""WITH p AS (SELECT 30000 AS cap), o AS (SELECT coalesce(sum(CAST(value AS DECIMAL(18,2))), 0)::DECIMAL(38,2) AS observed FROM events WHERE ts >= TIMESTAMP '2024-01-01')
           SELECT NOT (observed >= cap) AS ok, observed, cap::BIGINT AS cap, ceil(cap * 0.7)::BIGINT AS warn, CASE WHEN observed >= cap THEN 'hard_stop' WHEN observed >= ceil(cap * 0.7) THEN 'warning' END AS tripped, observed::DOUBLE / cap AS utilization FROM o, p""")
def budget_check(spark, d):
    old = schemas.conform(spark.createDataFrame([(1, 100)], "id int, cap_cents long"), "budget_policies")
    new = schemas.conform(spark.createDataFrame([(1, 30000, 70)], "id int, cap_cents long, warn_pct int"), "budget_policies")
    e = _t(spark, d, "events").select("ts", _money("value").alias("cost_cents"))
    found = ledger.check_budget(e, ledger.upsert(old, new, ["id"]), F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'"), "ts")
    return found.withColumn("observed", F.col("observed").cast("decimal(38,2)"))


@_query("SELECT user_id AS id, event_type AS threshold, value AS observed_cents FROM events WHERE event_id % 5 = 0")
def open_incidents(spark, d):
    e = _t(spark, d, "events")
    rows = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("threshold"), F.col("value").alias("observed_cents"), F.col("ts").alias("opened_at"), F.when(F.col("event_id") % 5 == 0, "open").otherwise("resolved").alias("status"))
    return ledger.open_now(rows).select("id", "threshold", "observed_cents")


@_query("""SELECT source, count(*) FILTER (n_chars > 1000) AS kept, count(*) AS seen, count(*) > 20 AS muted, count(*) FILTER (n_chars > 1000)::DOUBLE / count(*) AS rate FROM documents WHERE lang = 'en' GROUP BY source""")
def source_stats(spark, d):
    s = _t(spark, d, "documents").groupBy(F.col("lang").alias("routine"), "source").agg(F.count_if(F.col("n_chars") > 1000).alias("kept"), F.count(F.lit(1)).alias("seen")).withColumn("muted", F.col("seen") > 20)
    return ledger.stats_of(s, "en")


@_query("""WITH s AS (SELECT l_orderkey, greatest(l_quantity::BIGINT - l_linenumber * 2 - (l_tax * 100)::BIGINT, 0) AS regular FROM lineitem) SELECT l_orderkey AS run_id, sum(regular)::BIGINT AS regular FROM s GROUP BY 1""")
def token_split(spark, d):
    l = _t(spark, d, "lineitem")
    regular = ledger.split_tokens(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long") * 2, F.round(F.col("l_tax") * 100).cast("long"))
    return ledger.rollup(l.select(F.col("l_orderkey").alias("run_id"), regular.alias("r")), ["run_id"], {"regular": "r"})


@_query("""SELECT 'status is not allowed' AS rule, count(*) AS n FROM orders HAVING count(*) > 0 UNION ALL SELECT 'invocation is null', count(*) FROM orders WHERE o_orderstatus = 'O' HAVING count(*) > 0
           UNION ALL SELECT 'id is not unique', (count(*) - count(DISTINCT o_custkey))::BIGINT FROM orders HAVING count(*) > count(DISTINCT o_custkey) UNION ALL SELECT 'id is unknown', count(*) FROM orders WHERE o_custkey % 2 = 1 HAVING count(*) > 0""")
def schema_violations(spark, d):
    """Orders as runs of which some break the rules: no such status, no invocation, repeated ids, ids that no parent has."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.lit("p").alias("project"), F.when(F.col("o_orderstatus") != "O", "manual").alias("invocation"), F.lit("odd").alias("state"), F.current_timestamp().alias("started_at"))
    rows = schemas.conform(o, "runs").withColumn("status", F.lit("odd"))
    known = _t(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    return schemas.violations(rows, "runs", known, "id")
