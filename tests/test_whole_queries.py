"""Queries over whole tables, without SQL, against brute force."""

import random
import re

import pyarrow.parquet as pq
import pytest

from lumenloom import catalogue
from lumenloom.functions.text import STOP_WORDS
from lumenloom.operators import evidence


def table(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def toks(x):
    return {w for w in re.findall("[a-z0-9]+", (x or "").lower()) if len(w) >= 3}


def brute_similar(rows, least):
    """(key, class, links, similarity) of each row."""
    sets = [(k, frozenset(toks(x))) for k, x in rows]
    classes = {}
    for k, x in sets:
        classes[x] = min(k, classes.get(x, k))
    score = lambda a, b: len(a & b) / len(a | b)
    links = {x: [v for y in classes if y and y != x and (v := score(x, y)) > least] for x in classes if x}
    return sorted((k, classes[x] if x else k, len(links.get(x, ())), round(max(links.get(x, ()), default=0), 6) or None) for k, x in sets)


def similar(df, key):
    return sorted((r[key], r.class_id, r.n_links, None if r.similarity is None else round(r.similarity, 6)) for r in df.collect())


@pytest.mark.parametrize("least", [0.3, 0.5, 0.85])
def test_similar_documents_of_many_copies_and_sizes(spark, least):
    rng = random.Random(3)
    rows = [(k, "alpha beta gamma delta") for k in range(60)] + [(60 + k, f"alpha beta gamma word{k}") for k in range(5)] + [(70, None), (71, "a b"), (72, ""), (73, None)]
    long = [f"t{k}00" for k in range(90)]
    rows += [(100 + k, " ".join(rng.sample(long, rng.choice([3, 8, 40, 60, 80, 88])))) for k in range(60)]
    rows += [(200 + k, " ".join(long[: 2**k])) for k in range(7)] + [(210, "Delta beta alpha gamma"), (210, "repeated id")]
    got = evidence.similar_documents(spark.createDataFrame(rows, "k long, t string"), "k", "t", least)
    assert similar(got, "k") == brute_similar(rows, least)
    assert evidence.similar_documents(spark.createDataFrame([], "k long, t string"), "k", "t", least).count() == 0


def near_copies(n, size, apart):
    """Rows of near copies of one text."""
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(size)]
    return [(k, " ".join(base[:-apart] + [f"own{k}of{j}" for j in range(apart)])) for k in range(n)]


def test_similar_documents_take_disk_for_sets_and_not_for_pairs(spark, tmp_path):
    """Near copies all are links of each other, but what is shuffled follows the texts, and goes when its step is done."""
    path, rows = str(tmp_path / "docs"), near_copies(90, 300, 4)
    spark.createDataFrame(rows, "k long, t string").coalesce(2).write.parquet(path)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before, files = spark.conf.get(setting), written(), kept()
    got = evidence.similar_documents(spark.read.parquet(path), "k", "t", 0.85)
    assert kept() <= files and spark.conf.get(setting) == was
    assert similar(got, "k") == brute_similar(rows, 0.85)
    assert written() - before < 4 * sum(len(t) for _, t in rows)


def test_similar_documents_of_a_wide_neighbourhood_by_squares(spark, monkeypatch):
    monkeypatch.setattr(evidence, "BLOCK", 3)
    monkeypatch.setattr(evidence, "SHIPPED", 40)  # in rounds
    rows = near_copies(25, 80, 4) + [(100 + k, f"one two three four five six seven eight {x}") for k, x in enumerate(("", "nine", "ten", "nine ten"))]
    rows += [(200, " ".join(f"left{j}" for j in range(20))), (200, " ".join(f"right{j}" for j in range(20))), (201, " ".join(f"left{j}" for j in range(21))), (202, " ".join(f"right{j}" for j in range(19)))]
    got = evidence.similar_documents(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.85)
    assert similar(got, "k") == brute_similar(rows, 0.85)


def test_similar_documents_of_the_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(sf_dir, "documents")]
    got = evidence.similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 0.3)
    assert similar(got, "doc_id") == brute_similar(rows, 0.3)
    assert similar(catalogue.queries()["near_dup_jaccard"](spark, sf_dir), "doc_id") == brute_similar(rows, 0.85)


def test_embedding_queries_are_all_ids_divisible_by_50(spark, sf_dir):
    import numpy as np

    rows = table(sf_dir, "embeddings")
    ids, label = [r["vec_id"] for r in rows], {r["vec_id"]: r["label"] for r in rows}
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    top, first = [], []
    asked = [i for i in ids if i % 50 == 0]
    for q in asked:
        c = unit @ unit[ids.index(q)]
        order = sorted((-round(float(v), 9), i) for v, i in zip(c, ids, strict=True) if i != q)
        top += [(q, i, k + 1) for k, (_, i) in enumerate(order[:3])]
        first.append(next((k + 1 for k, (_, i) in enumerate(order) if label[i] == label[q]), None))
    got = catalogue.queries()["retrieve_topk"](spark, sf_dir).collect()
    assert sorted((r.query_id, r.item_id, r.rank) for r in got) == sorted(top)
    m = catalogue.queries()["mrr_recall_at_k"](spark, sf_dir).first()
    assert m.n == len(asked) and abs(m.mrr - sum(1 / f for f in first if f) / len(first)) < 1e-8
    assert abs(m.recall_at_k - sum(bool(f and f <= 10) for f in first) / len(first)) < 1e-8


def content(x):
    return toks(x) - set(STOP_WORDS)


def items(sf_dir):
    return [(r["item_id"], r["text"]) for r in table(sf_dir, "benchmark") if r["item_id"] % 50 == 0]


def test_best_passage_of_all_documents(spark, sf_dir):
    want = []
    for item, claim in items(sf_dir):
        for r in table(sf_dir, "documents"):
            x = r["text"]
            parts = [x] if len(x) <= 800 else [x[i : i + 800] for i in range(0, len(x), 680)]
            shared = [len(content(claim) & content(p)) for p in parts if p.strip()]
            if shared:
                want.append((item, r["doc_id"], shared.index(max(shared)), max(shared)))
    got = catalogue.queries()["best_passage"](spark, sf_dir).collect()
    assert sorted((r.item_id, r.doc_id, r.pos, r.shared) for r in got) == sorted(want)


def test_token_f1_of_all_documents(spark, sf_dir):
    f1 = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0
    every = lambda x: set(re.findall("[a-z0-9]+", (x or "").lower()))
    want = {(i, r["doc_id"]): round(max(f1(every(c), every(x)) for x in re.split(r"(?<=[.!?;])\s+|\n", r["text"])), 3) for i, c in items(sf_dir) for r in table(sf_dir, "documents")}
    got = {(r.item_id, r.doc_id): r.score for r in catalogue.queries()["token_f1_best_sentence"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_overlap_verify_of_all_documents(spark, sf_dir):
    want = []
    for item, claim in items(sf_dir):
        words, stated = content(claim), re.findall(r"(?<![A-Za-z0-9])(\d+(?:\.\d+)?)(?![A-Za-z0-9])", claim)
        for r in table(sf_dir, "documents"):
            if shared := len(words & content(r["text"])):
                want.append((item, r["doc_id"], shared, shared / len(words) >= 0.5 and all(n in r["text"].lower() for n in stated)))
    got = catalogue.queries()["overlap_verify"](spark, sf_dir).collect()
    assert sorted((r.item_id, r.doc_id, r.shared, r.ok) for r in got) == sorted(want)


def test_quotes_of_all_lengths(spark):
    sources = [(1, "One two  three four five six SEVEN eight"), (2, "xtwo three four five sixy"), (3, "two three"), (4, None), (5, "a b c d e f g")]
    quotes = [(1, "two three four five six"), (2, "wo three four five si"), (3, "two three"), (4, "  "), (5, "b c d e f g"), (6, "b c d x f g"), (7, None)]
    got = evidence.quoted(spark.createDataFrame(quotes, "q long, quote string"), spark.createDataFrame(sources, "k long, body string"), "quote", "body", "k").select("q", "k").collect()
    flat = lambda x: " ".join((x or "").lower().split())
    assert sorted(map(tuple, got)) == sorted((q, k) for q, a in quotes for k, b in sources if flat(a) and b and flat(a) in flat(b))


def test_neighbours_by_blocks_are_those_of_the_nested_loop(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lumenloom.operators import vectors

    monkeypatch.setattr(vectors, "ITEM_ROWS", 16)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    # queries of any number are not held whole: no nested loop over rows, with a broadcast or without
    monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", 0)
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)], rng.choice([1, 2, None])) for k in range(70)]
    rows += [(70 + k, [1.0, 0.5, 1.0, -1.0], 1) for k in range(40)] + [(110, [0.0] * 4, 1), (111, None, 1), (112, [1.0, None, 0.5, 1.0], 1), (113, [1.0, 0.5], 1), (114, [float("nan"), 1.0, 1.0, 1.0], 7)]
    rows += [(115, [1e200, 1.0, 0.0, 0.0], 2), (120, [], 2), (None, [1.0] * 4, 1)]
    e = spark.createDataFrame(rows, "i long, v array<double>, label int")
    asked = e.where("i % 5 = 0 OR i > 110")
    pairs = asked.select(F.col("i").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("l")).crossJoin(e.select(F.col("i").alias("item_id"), "v", "label")).where("query_id <> item_id")
    ranked = pairs.select("query_id", "item_id", evidence.cosine(F.col("q"), F.col("v")).alias("s"), F.coalesce(F.col("l") == F.col("label"), F.lit(False)).alias("hit"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "item_id"))).cache()
    said = lambda r: (r[0], r[1], repr(r[2]), r[3])
    want = sorted(said(r) for r in ranked.where("rank <= 4").select("query_id", "item_id", "s", "rank").collect())
    got = evidence.top_k(asked, e, "i", "i", "v", 4)
    assert sorted(said(r) for r in got.select("query_id", "item_id", "similarity", "rank").collect()) == want
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))))
    assert sorted(map(tuple, evidence.first_hits(asked, e, "i", "i", "v", "label").collect())) == sorted(map(tuple, first.collect()))
    text = e.select(F.col("i").cast("string").alias("i"), "v", "label")
    assert evidence.top_k(text.where("i = '7'"), text, "i", "i", "v", 4).count() == 4
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_document_is_taken_apart_once_for_all_items(spark, sf_dir):
    plan = catalogue.queries()["token_f1_best_sentence"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join")
    assert "regexp_extract_all" not in above and "regexp_extract_all" in below


def test_unlike_sets_of_common_tokens_hardly_meet(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    every = [f"t{k:03}" for k in range(600)]  # each in a sixth of the sets
    rows = [(k, sorted(rng.sample(every, rng.randrange(95, 105)))) for k in range(300)]
    rows += [(1000 + k, sorted({*rows[k][1][3:], f"own{k}"})) for k in range(20)]
    held = evidence.signatures(spark.createDataFrame(rows, "c long, w array<string>").withColumn("n", F.size("w")), 0.85).select("c", "signature")
    met = {tuple(r) for r in held.join(held.withColumnRenamed("c", "d"), "signature").where("c < d").select("c", "d").distinct().collect()}
    assert {(k, 1000 + k) for k in range(20)} <= met
    assert len(met) < 0.01 * len(rows) * len(rows) / 2


@pytest.mark.parametrize("least", [0.5, 0.85])
def test_nearest_is_the_best_of_all_pairs(spark, least):
    rng = random.Random(7)
    some = lambda: " ".join(rng.sample([f"tok{k}" for k in range(14)], rng.randrange(0, 13)))
    mine, theirs = [(k, some()) for k in range(40)] + [(90, None), (91, "a b")], [(some(),) for _ in range(40)] + [(None,)]
    score = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = {k: max(score(toks(x), toks(y)) for (y,) in theirs) for k, x in mine}
    got = evidence.nearest(spark.createDataFrame(mine, "k long, t string"), spark.createDataFrame(theirs, "u string"), "k", "t", "u", least)
    assert {r.k: round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items() if v > least}
