"""Claims against texts by what the texts hold, held against the pair of each claim and its texts."""

import random

from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.operators import evidence, synthesis, texts_asked

PIECES = ["5", "7 %", "1.2.3", "12", "3.5%", "CD25", "IL2RA", "cd4", "CD45RA-x", "alpha", "beta", "gamma", "delta", "Foxp3", "5.", "40‰", "\n", ". ", "; ", "(CD8)", "1.2", "#3", "123456789012345678901234567890", "PD-L1", "word"]


def made(rng, n):
    return " ".join(rng.choice(PIECES) for _ in range(n))


def project(rng):
    claims = [(1, k, 0, made(rng, rng.choice([1, 3, 6])), [(f"[A{j} 2020]", f"a{j}", False) for j in rng.sample(range(4), rng.choice([1, 2]))]) for k in range(120)]
    claims += [(1, 200, 0, "shows 5% here", [("[A0 2020]", "a0", False), ("[A1 2020]", "a1", False)]), (1, 201, 0, "?", [("[A0 2020]", "a0", False)]), (1, 202, 0, "from outside", [("[External Review]", "", True)]), (1, 203, 0, "no file", [("[B 2020]", "b", False)])]
    files = {f"f{j}": made(rng, 40) for j in range(3)} | {"f3": "  "}
    files["f0"], files["f1"] = files["f0"] + " 5", "% " + files["f1"]
    return claims, [(1, f"a{j}", f"f{j}", j) for j in range(4)], [(1, f, x) for f, x in files.items()]


def frames(spark, parts):
    claims, mapping, notes = parts
    shape = "project long, line int, pos int, claim string, citations array<struct<raw:string,key:string,external:boolean>>"
    return spark.createDataFrame(claims, shape), spark.createDataFrame(mapping, "project long, citation string, file string, line int"), spark.createDataFrame(notes, "project long, file string, text string")


def test_claims_are_scored_as_against_their_joined_texts(spark):
    parts = project(random.Random(4))
    claims, mapping, notes = frames(spark, parts)
    texts = {f: x for _, f, x in parts[2] if x.strip()}
    pairs = [(c[1], c[3], "\n".join(texts[f] for _, k, _ in c[4] if (f := "f" + k[1:]) in texts)) for c in parts[0] if any("f" + k[1:] in texts for _, k, _ in c[4])]
    each = spark.createDataFrame(pairs, "line int, claim string, evidence string")
    want = each.select("line", synthesis.number_grounded(F.col("claim"), F.col("evidence")), synthesis.entity_grounded(F.col("claim"), F.col("evidence")), evidence.best_sentence_f1(F.col("claim"), F.col("evidence")))
    got = synthesis.score_claims(claims, mapping, notes, "project")
    assert sorted(map(tuple, got.select("line", "number_grounded", "entity_grounded", "lexical_overlap").collect())) == sorted(map(tuple, want.collect()))
    assert "evidence" not in synthesis.resolved(claims, mapping, notes, "project").columns  # no text beside a claim


def test_pairings_by_the_rule_are_those_of_a_verifier_that_reads_both(spark):
    claims, mapping, notes = frames(spark, project(random.Random(6)))
    said = lambda df: sorted(map(tuple, df.select("line", "claim", "citation", "evidence_file", "label", "note").collect()))
    assert said(synthesis.pairings(claims, mapping, notes, "project")) == said(synthesis.pairings(claims, mapping, notes, "project", lambda a, b: text.supported(a, b)))


def test_best_f1_at_all_levels(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(texts_asked, "COMPARED", 3)
    words = [f"t{k}" for k in range(14)]
    asked = [(k, k % 2, sorted(rng.sample(words, rng.choice([1, 2, 5, 9])))) for k in range(60)] + [(90, 0, ["t0", "zz"]), (91, 1, ["zz"])]
    sentences = {p: [rng.sample(words, rng.choice([2, 4, 6, 10])) for _ in range(12)] for p in (0, 1)}
    texts = spark.createDataFrame([(p, "\n".join(" ".join(x) for x in s)) for p, s in sentences.items()], "place long, text string")
    one = lambda a, b: 2.0 * len(set(a) & set(b)) / (len(a) + len(b))
    want = {i: max(one(w, s) for s in sentences[p]) for i, p, w in asked}
    got = {r.id: r.f1 for r in texts_asked.best_f1(spark.createDataFrame(asked, "id long, place long, w array<string>"), texts, evidence.SENTENCE).collect()}
    assert {i: got.get(i, 0.0) for i in want} == want and min(want.values()) < 0.5
