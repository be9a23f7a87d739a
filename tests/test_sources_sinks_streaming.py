import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import policy
from lumenloom.plans import sinks
from lumenloom.sources import connectors, corpora
from lumenloom.streaming import jobs

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
 b</title><summary>s</summary><published>2024-01-05T00:00:00Z</published><arxiv:doi>10.1/x</arxiv:doi><link title="pdf" href="http://p"/></entry>
<entry><id>http://arxiv.org/abs/2301.1</id><title>old</title><published>2023-01-05</published></entry>
<entry><id>http://arxiv.org/abs/9</id><title>undated</title></entry></feed>"""


def test_connectors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.xml").write_text(ATOM)
    (tmp_path / "a/2.xml").write_text("<broken")
    got = sorted((r.arxiv_id, r.title, r.year) for r in connectors.read_arxiv(spark, str(tmp_path / "a"), dt.date(2024, 1, 1)).collect())
    assert got == [("2401.00001v2", "A b", 2024), ("9", "undated", None)]
    (tmp_path / "e.json").write_text(json.dumps({"resultList": {"result": [{"title": "t", "pmid": "7", "pubYear": "2020", "journalInfo": {"journal": {"title": "J"}}}]}}))
    r = connectors.read_europe_pmc(spark, str(tmp_path / "e.json")).first()
    assert (r.pmid, r.year, r.journal, r.source) == ("7", 2020, "J", "pubmed")
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"paperId": "p", "title": "t", "publicationDate": "2024-02-03", "externalIds": {"DOI": "10.1/y"}}, {"paperId": "q", "publicationDate": "1999-01-01"}]}))
    assert [(r.s2_id, r.doi, r.year) for r in connectors.read_semantic_scholar(spark, str(tmp_path / "s.json"), dt.date(2020, 1, 1)).collect()] == [("p", "10.1/y", 2024)]
    assert connectors.europe_pmc_query("q", dt.date(2024, 1, 2), journals=["A"]) == '(q) AND SRC:MED AND FIRST_PDATE:[2024-01-02 TO 3000-01-01] AND (JOURNAL:"A")'
    urls = spark.createDataFrame([("10.1101/z", "2401.1", "")], "d string, a string, p string").select(connectors.pdf_urls(F.col("d"), F.col("a"), F.col("p")).alias("u")).first().u
    assert urls == ["https://arxiv.org/pdf/2401.1", "https://www.biorxiv.org/content/10.1101/zv1.full.pdf"]


def test_evidence_files(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("a_evidence.json", {"paper_id": "A", "relevance": "LOW"})
    put("a_evidence.regrounded.json", {"paper_id": "A", "relevance": "HIGH", "findings": [{"statement": "s"}]})
    put("b_evidence.json", [{"relevance": "MODERATE"}, {"paper_id": "A"}])
    put("c.json", "not json {")
    got = {r.paper_id: (r.relevance, r.findings) for r in corpora.read_evidence(spark, str(tmp_path)).collect()}
    assert got["A"][0] == "HIGH" and got["A"][1][0].statement == "s" and got["b#0"][0] == "MODERATE"


def test_corpora(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1|t|Title one\n1|a|Abstract\n1\t0\t5\tIL2\tGeneOrGeneProduct\t99\n1\t6\t9\tinterleukin 2\tGeneOrGeneProduct\t99\n1\t1\t2\tx\tOther\t1\n\n2|t|T\n2|a|A\n")
    r = corpora.read_pubtator(spark, str(tmp_path / "p.txt"), {"GeneOrGeneProduct": "genes"}).collect()
    assert [(x.doc_id, x.text, x.field, x.concepts) for x in r] == [("1", "Title one Abstract", "genes", [["il2", "interleukin 2"]])]
    (tmp_path / "i.txt").write_text("###MEDLINE:1\n\nT\tB-cell\ncells\tI-cell\nand\tO\nB\tB-cell\n\ncells\tI-cell\n")
    assert sorted((x.entity, x.kind) for x in corpora.read_iob(spark, str(tmp_path / "i.txt")).collect()) == [("B", "cell"), ("T cells", "cell"), ("cells", "cell")]
    (tmp_path / "o.obo").write_text('x\n[Term]\nid: CL:1\nname: T cell\nsynonym: "T lymphocyte" EXACT []\nsynonym: "TL" RELATED []\n\n[Term]\nid: CL:2\nname: t Lymphocyte\n\n[Term]\nid: CL:3\nname: gone\nis_obsolete: true\n')
    terms = corpora.read_obo(spark, str(tmp_path / "o.obo"))
    assert {r.id: r.spellings for r in terms.collect()} == {"CL:1": ["t cell", "t lymphocyte"], "CL:2": ["t lymphocyte"]}
    assert [tuple(r) for r in corpora.unambiguous(terms).collect()] == [("t cell", "CL:1")]
    (tmp_path / "in.csv").write_text('ReviewID,PMID,Title,Abstract\n1,2,t,"a ""q"", x\ny"\n1,3,t,\n2,4,t,z\n')
    (tmp_path / "out.csv").write_text("ReviewID,Target\n1,goal\n")
    assert [(r.review_id, len(r.studies), r.target) for r in corpora.read_reviews(spark, str(tmp_path / "in.csv"), str(tmp_path / "out.csv")).collect()] == [("1", 1, "goal")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 0.12349, "x|y"), (2, None, None, None)], "id int, l array<string>, d double, s string")
    assert [tuple(r) for r in sinks.flat(df).orderBy("id").collect()] == [(1, "a; b", "0.123", "x|y"), (2, None, None, None)]
    assert "| 1 | a; b | 0.123 | x\\|y |" in sinks.markdown_table(df)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert sinks.append_missing(df, str(tmp_path / "p"), ["id"]).count() == 2
    again = spark.createDataFrame([(2, None, None, "dup"), (3, None, None, "new")], df.schema)
    sinks.append_missing(again, str(tmp_path / "p"), ["id"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 2, 3]


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_streams_equal_batch(spark, tmp_path):
    steps = [("r", s, k, (7 * k + len(s)) % 13, (3 * k) % 4) for s in ("a", "bb") for k in range(12)]
    shape = "routine string, source string, step int, seen int, kept int"
    rule = policy.Policy(10, 0.3, 3)
    for part in range(3):
        spark.createDataFrame([x for x in steps if x[2] // 4 == part], shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).json(str(tmp_path / "in"))
        q = jobs.source_policy(stream, rule).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    got = {(r.source, r.step): (r.decision, r.seen, r.muted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.source, r.step): (r.decision, r.total_seen, r.muted) for r in policy.replay(spark.createDataFrame(steps, shape), rule).collect()}
    assert got == want


def test_link_once_and_spend_streams(spark, tmp_path):
    rows = [(k, "2024-01-0%dT00:00:00" % (1 + k % 3), f"u{k % 4}", 1.5) for k in range(24)]
    shape = "id int, ts timestamp, user string, value double"
    spark.createDataFrame([(a, dt.datetime.fromisoformat(b), c, d) for a, b, c, d in rows], shape).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).json(str(tmp_path / "in"))
    drain(jobs.link_once(stream, ["user"], "ts").writeStream.format("memory").queryName("linked").start())
    assert spark.table("linked").count() == 4
    drain(jobs.spend(stream, "ts", "user", "value").writeStream.format("memory").queryName("spent").outputMode("complete").start())
    assert spark.table("spent").agg(F.sum("n"), F.sum("spent")).first() == (24, 36.0)
    gated = jobs.with_gate(stream, lambda b: False, lambda b, n: None).start()
    with pytest.raises(Exception, match="budget reached"):
        gated.processAllAvailable()
    gated.stop()
