"""The queries opN_* of the training-data operators, and their DuckDB oracles.

Each query applies its operator to whole tables and derives the columns of its contract from what the
operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import attention_lm, dac, digests, langid, line_spread, mixing, packing, phrases, rule_ledger, secret_scan, simhash, toxicity, vector_codes
from lumenloom.llm.common import documents
from lumenloom.llm.oracles import ORACLES


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).drop("mixture")


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rule_ledger.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base, newest = rule_ledger.passes(rule_ledger.POLICIES["base"]), rule_ledger.passes(rule_ledger.POLICIES[rule_ledger.PRODUCTION])
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), newest.alias("kept"), "failures")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version costs and would give back, from the ledger's bitmasks alone."""
    return rule_ledger.ablations(rule_ledger.ledger(documents(spark, sf_dir).select("doc_id", "text")))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op4_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_documents(dac.write_codes(documents(spark, sf_dir), end_id=2))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.classify(docs, chain)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edit_digests(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = said(F.filter("spans", lambda x: x["kind"] != "lexed"))
    named = F.filter("spans", lambda x: x["name"].isNotNull())
    names = F.array_join(F.transform(named, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["name"])), ",").alias("names")
    score = F.array_max(F.transform(named, lambda x: x["score"])).alias("top_score")
    spans = said(F.col("spans")).alias("spans")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("lexed"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans, names, score)


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_spread.remove_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return kept.select("doc_id", "text", "n_lines", "n_removed")


def op11_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(documents(spark, sf_dir))


def op12_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = vector_codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_mixture, op2_rule_ledger, op3_vector_packing, op4_direct_codes, op5_toxicity_chain,
        op6_source_mix, op7_simhash_pivots, op8_canonical_digest, op9_secret_scan, op10_line_spread,
        op11_attention_lm, op12_suffix_sigma, op13_vector_codes, rule_ablations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
