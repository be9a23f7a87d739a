"""Queries of acquisition, of the library in batches and of model calls, on records made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom import catalogue
from lumenloom.catalogue import _query, _t
from lumenloom.operators import ledger, model_calls
from lumenloom.operators.library_table import LibraryTable
from lumenloom.runtime import shared_dir
from lumenloom.sources import literature


def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/lumenloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@_query("""WITH d AS (SELECT doc_id, source, (DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER))::VARCHAR AS day FROM documents WHERE doc_id % 3 <> 2)
           SELECT doc_id::VARCHAR AS pmid, 'doc ' || doc_id AS title, source AS journal, day AS published, 2024 AS year FROM d WHERE doc_id % 3 = 0 AND day >= '2024-01-20' AND source IN ('src1', 'src2', 'src3')""")
def literature_pushdown(spark, d):
    """Documents saved as a service's answers by day; the filters of the query are what the service is asked."""
    folder = _folder(spark, "answers")
    docs = _t(spark, d, "documents").where("doc_id % 3 <> 2")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("string")
    record = F.to_json(F.struct(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("journalTitle"), day.alias("firstPublicationDate"), F.lit("2024").alias("pubYear")))
    service = F.when(F.col("doc_id") % 3 == 0, "europepmc").otherwise("europepmc_ppr")
    docs.select(record.alias("value"), service.alias("source"), day.alias("day")).write.partitionBy("source", "day").text(folder)
    name = literature.register(spark, literature.Replay(folder), "literature_pushdown")
    found = spark.read.format(name).option("queries", "any").option("sources", "europepmc,europepmc_ppr").option("until", "2024-12-31").load()
    kept = found.where("source = 'europepmc' AND published >= '2024-01-20' AND journal IN ('src1', 'src2', 'src3')")
    return kept.select("pmid", "title", "journal", "published", "year")


@_query()
def library_in_batches(spark, d):
    """The records of ``paper_merge`` in three batches by arrival; held against the whole fold, which SQL cannot say."""
    records = catalogue.paper_records(spark, d)
    library = LibraryTable(spark, _folder(spark, "library"), 8)
    n = records.agg(F.max("seq")).first()[0] or 0
    for k in range(3):
        library.merge(records.where((F.col("seq") > (k * n) // 3 - (k == 0)) & (F.col("seq") <= ((k + 1) * n) // 3)), k)
    return library.papers()


class _Lengths:
    """A model that answers with a prompt's length and bills a token for each of its characters."""

    def __call__(self, prompt: str) -> model_calls.Answer:
        return model_calls.Answer(str(len(prompt)), f"model-{len(prompt) % 3}", len(prompt), 2, 1, 0)


@_query("""WITH c AS (SELECT source AS run_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
           SELECT run_id, count(*) AS n_calls, sum(n)::BIGINT AS input_tokens, round(sum((CASE n % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 300.0 ELSE 0 END) * n + (CASE n % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 0 END) + 2 * (CASE n % 3 WHEN 0 THEN 500.0 WHEN 1 THEN 1500.0 ELSE 0 END)) / 1000000, 6) AS cost_cents
           FROM c GROUP BY run_id""")
def model_usage_bill(spark, d):
    """Every document as a prompt, a run a source; the calls are asked for twice and billed once. Two of three models have a price."""
    rows = _t(spark, d, "documents").select("source", "doc_id", "text")
    pricing = spark.createDataFrame([("model-0", 100.0, 500.0, 10.0), ("model-1", 300.0, 1500.0, 30.0)], "model string, input_cents_per_mtok double, output_cents_per_mtok double, cached_input_cents_per_mtok double")
    answers, book = _folder(spark, "answers"), _folder(spark, "ledger")
    for _ in range(2):
        held = model_calls.answered(rows, ["source", "doc_id"], "text", _Lengths, answers)
        billed = model_calls.bill(model_calls.usage_events(held, "source", "doc_id"), pricing, book)
    amounts = ledger.rollup(billed, ["run_id"], {"input_tokens": "input_tokens", "cost_cents": "cost_cents"})
    return amounts.join(billed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls")), "run_id").select("run_id", "n_calls", "input_tokens", F.round("cost_cents", 6).alias("cost_cents"))
