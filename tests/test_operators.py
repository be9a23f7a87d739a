"""Hand-computed values and brute-force comparisons of the library's operators."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.operators import evidence, graph, ledger, metrics, parsing, policy, resolve, schedule, triage


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


# text


@pytest.mark.parametrize(("raw", "want"), [(" https://DX.doi.org/10.1/AbC ", "10.1/abc"), ("doi:10.1/x", "10.1/x"), ("", None), ("  ", None), (None, None)])
def test_doi(spark, raw, want):
    assert one(spark, text.norm_doi(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("arXiv:2401.00001v3", "2401.00001"), ("2401.1", "2401.1"), ("", None)])
def test_arxiv(spark, raw, want):
    assert one(spark, text.norm_arxiv(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    ("answer", "label", "score"),
    [
        ("RELEVANT 0.85", "RELEVANT", 0.85), ("Not relevant. 0.2", "NOT_RELEVANT", 0.2), ("I am not sure", "NOT_RELEVANT", 0.1), ("RELEVANT. It does not matter", "RELEVANT", 0.8),
        ("the label must surely be BORDERLINE", "BORDERLINE", 0.5), ("hm", "UNKNOWN", 0.3), ("", "UNKNOWN", 0.3), ("RELEVANT 7", "RELEVANT", 0.8),
    ],
)
def test_labels(spark, answer, label, score):
    assert one(spark, text.parse_label(F.col("a")), a=answer) == label
    assert one(spark, text.parse_score(F.col("a"), F.lit(label)), a=answer) == score


@pytest.mark.parametrize(("a", "b", "want"), [("30 %", "30%", True), (">10%", "below 10%", False), (">10%", "10%", False), ("5", "5 m", False), ("30 c", "30 °c", True), ("at least 3 cells", "no less than 3 cells", True), ("high", "high level", True), ("high", "low", False), ("10-20 %", "20-10 %", True)])
def test_numbers_match(spark, a, b, want):
    assert one(spark, text.number_match(F.col("a"), F.col("b")), a=a, b=b) is want


def test_overlap_needs_words_and_numbers(spark):
    passage = "CD4 T cells made up 25-40 % of lymphocytes in treated patients"
    check = text.supported(F.col("a"), F.col("b"))
    assert one(spark, check, a="T cells 40 % of lymphocytes", b=passage).ok
    assert not one(spark, check, a="T cells 99 % of lymphocytes", b=passage).ok
    assert not one(spark, check, a="", b=passage).ok


def test_chunks_cover_the_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(2000))
    got = one(spark, text.chunks(F.col("a")), a=body)
    assert got == [body[i : i + 800] for i in range(0, 2000, 680)]
    assert one(spark, text.chunks(F.col("a")), a=" \n") == [] and one(spark, text.chunks(F.col("a")), a="ab") == ["ab"]


# ledger


def test_cache_pricing(spark):
    events = spark.createDataFrame([("m", 1000, 500, 2000, 400, None), ("other", 9, 9, 9, 9, None), ("other", 1, 1, 1, 1, 0.02)], "model string, input_tokens long, output_tokens long, cached_input_tokens long, cache_creation_tokens long, total_cost_usd double")
    pricing = spark.createDataFrame([("m", 300.0, 1500.0, 30.0)], "model string, input_cents_per_mtok double, output_cents_per_mtok double, cached_input_cents_per_mtok double")
    got = sorted((r.model, round(r.cost_cents, 9), r.cost_source) for r in ledger.priced(events, pricing).collect())
    assert got == [("m", 1.26, "computed"), ("other", 0.0, "computed"), ("other", 2.0, "sdk_reported")]


def test_budget_states(spark):
    seen = spark.createDataFrame([(5.0,), (6.0,), (7.0,)], "observed double")
    assert [(r.warn, r.tripped, r.ok) for r in ledger.budget_state(seen, 7, 80).orderBy("observed").collect()] == [(6, None, True), (6, "warning", True), (6, "hard_stop", False)]
    assert ledger.budget_state(seen, 7, 80, hard_stop=False).where("NOT ok").count() == 0
    assert {r.utilization for r in ledger.budget_state(seen, 0, 80).collect()} == {0.0}


def test_incidents_open_once(spark):
    old = spark.createDataFrame([("warning", "2024-01")], "threshold string, window_start string")
    new = spark.createDataFrame([("warning", "2024-01", 3), ("warning", "2024-02", 5), ("warning", "2024-02", 4)], "threshold string, window_start string, opened_at int")
    assert [tuple(r) for r in ledger.open_incidents(old, new).collect()] == [("warning", "2024-02", 4)]


def test_upsert_and_coalesce(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", "kept")], "k int, v string, s string")
    changes = spark.createDataFrame([(1, None, "new"), (3, "c", "x")], "k int, v string, s string")
    assert sorted(map(tuple, ledger.upsert(table, changes, ["k"]).collect())) == [(1, None, "new"), (2, "b", "kept"), (3, "c", "x")]
    assert sorted(map(tuple, ledger.coalesce_update(table, changes, ["k"], ["v", "s"]).collect())) == [(1, "a", "new"), (2, "b", "kept")]


# policy


def test_mute_boundary_and_reprobe(spark):
    rule = policy.Policy(10, 0.20, 3)
    steps = [("r", "a", k, *x) for k, x in enumerate([(10, 2), (10, 0), (5, 5), (5, 5), (5, 5), (5, 5)])] + [("r", "b", 0, 0, 0), ("r", "b", 1, 9, 0), ("r", "b", 2, 1, 0), ("r", "b", 3, 1, 1)]
    got = {(r.source, r.step): (r.decision, r.muted) for r in policy.replay(spark.createDataFrame(steps, "routine string, source string, step int, seen int, kept int"), rule).collect()}
    # two of ten is the threshold itself and does not mute; two of twenty does; every third muted turn probes
    assert [got["a", k] for k in range(6)] == [("run", False), ("run", True), ("muted_skip", True), ("muted_skip", True), ("reprobe", False), ("run", False)]
    assert [got["b", k] for k in range(4)] == [("run", False), ("run", False), ("run", True), ("muted_skip", True)]


# metrics


def brute_matching(gold, found, match):
    gold = sorted({tuple(sorted(g)) for g in gold})
    found = sorted(set(found))

    def best(i, used):
        if i == len(found):
            return 0
        options = [best(i + 1, used)]
        options += [1 + best(i + 1, used | {j}) for j, g in enumerate(gold) if j not in used and any(match(found[i], a) for a in g)]
        return max(options)

    tp = best(0, frozenset())
    return {"tp": tp, "fp": len(found) - tp, "fn": len(gold) - tp}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=2), max_size=6), st.lists(st.text("ab", min_size=1, max_size=3), max_size=6))
def test_matching_is_maximum(gold, found):
    match = lambda a, b: a in b or b in a
    assert metrics.maximum_matching(gold, found, match) == brute_matching(gold, found, match)


def test_matching_groups_take_nulls(spark):
    rows = spark.createDataFrame([(1, [["a"], ["ab", "x"]], ["x", "b"]), (2, None, ["q"]), (3, [["z"]], None)], "k int, gold array<array<string>>, found array<string>")
    got = {r.k: (r.tp, r.fp, r.fn) for r in metrics.match_groups(rows, ["k"], "gold", "found", lambda a, b: a == b).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 0), 3: (0, 0, 1)}


def test_scores_guard_zero(spark):
    counts = spark.createDataFrame([(2, 1, 1), (0, 0, 0)], "tp int, fp int, fn int")
    assert [tuple(round(x, 4) for x in r) for r in counts.select(*metrics.prf()).collect()] == [(0.6667, 0.6667, 0.6667), (0.0, 0.0, 0.0)]
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert metrics.kappa(same, "a", "b").first().kappa == 1.0


def test_bootstrap(spark):
    assert metrics.bootstrap([1.0] * 5, 100) == (1.0, 1.0, 1.0)
    mean, low, high = metrics.bootstrap([0.0, 1.0] * 50, 2000)
    assert mean == 0.5 and 0.35 < low < 0.45 < 0.55 < high < 0.65
    assert metrics.paired_bootstrap([1.0, 2.0], [0.0, 1.0], 50) == (1.0, 1.0, 1.0, 1.0)
    rows = spark.createDataFrame([("s", float(k % 2)) for k in range(100)] + [("t", 1.0), ("t", None)], "k string, v double")
    got = {r.k: r for r in metrics.bootstrap_groups(rows, "k", "v", 2000).collect()}
    assert got["t"].n == 1 and got["t"].low == 1.0 and 0.35 < got["s"].low < 0.45


def test_rotation(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "k int, o int, v string")
    assert [r.next_v for r in metrics.rotated(rows, "k", "o", "v").orderBy("o").collect()] == ["b", "c", "a"]


# resolution


def fold(records):
    """A direct model of the merge rules over one list of records."""
    papers = []
    for r in sorted(records, key=lambda r: r["seq"]):
        hits = []
        for c, _ in resolve.IDS:
            hits += [p for p in papers if r[c] and p[c] == r[c] and p not in hits]
        if not hits:
            name = next((x + r[c] for c, x in resolve.IDS if r[c]), None)
            if name:
                papers.append({c: r[c] for c, _ in resolve.IDS} | {"paper_id": name, "title": r["title"], "sources": {r["source"]}})
            continue
        into = hits[0]
        for other in hits[1:]:
            papers.remove(other)
        for other in (*hits[1:], r | {"sources": {r["source"]}}):
            for c in ("doi", "arxiv_id", "pmid", "s2_id", "title"):
                into[c] = into[c] or other[c]
            into["sources"] = into["sources"] | other["sources"]
    return sorted((p["paper_id"], p["doi"], p["arxiv_id"], p["pmid"], p["s2_id"], p["title"], tuple(sorted(p["sources"]))) for p in papers)


SCHEMA = "seq long, doi string, arxiv_id string, pmid string, s2_id string, title string, abstract string, year int, journal string, source string"


def merged(spark, records):
    rows = [(r["seq"], r["doi"], r["arxiv_id"], r["pmid"], r["s2_id"], r["title"], "", None, None, r["source"]) for r in records]
    return sorted((p.paper_id, p.doi, p.arxiv_id, p.pmid, p.s2_id, p.title, tuple(p.sources)) for p in resolve.merge_papers(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_a_global_fold(spark, seed):
    rng = random.Random(seed)
    pick = lambda p, n: rng.choice([None, None, *(f"{p}{k}" for k in range(n))])
    records = [{"seq": k, "doi": pick("d", 25), "arxiv_id": pick("a", 25), "pmid": pick("p", 25), "s2_id": pick("s", 25), "title": rng.choice([None, f"t{k}"]), "source": f"src{k % 4}"} for k in range(90)]
    assert merged(spark, records) == fold(records)


def test_bridging_record_merges_and_strongest_survives(spark):
    base = {"arxiv_id": None, "pmid": None, "s2_id": None, "title": None}
    records = [base | {"seq": 1, "doi": None, "pmid": "7", "title": "late", "source": "a"}, base | {"seq": 2, "doi": "10.1/x", "source": "b"}, base | {"seq": 3, "doi": "10.1/x", "pmid": "7", "source": "c"}]
    assert merged(spark, records) == [("doi:10.1/x", "10.1/x", None, "7", None, "late", ("a", "b", "c"))]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in resolve.connected(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert resolve.connected(edges.limit(0)).count() == 0


# parsing

SYNTHESIS = """---
title: x
---
# Heading
CD8 cells expand [Zheng 2025]. They persist [Li 2024] and [12] or [link]; see [External Review].
| marker | cells |
|---|:--|
| CD25 [O'Neil] | Treg |
```
[Code 2020]
```
```
── tree [Root 2019]
```
## Appendix A: sources
| [Zheng 2025] | `zheng_evidence.md` `zheng2_evidence.md` |
| [Li 2024] | `li_evidence.md` |
## Appendix B
[Zheng 2025] `other_evidence.md`
"""


def test_synthesis_parsing(spark):
    docs = spark.createDataFrame([(1, SYNTHESIS)], "id int, md string")
    found = parsing.claims(docs, "id", "md").orderBy("line", "pos").collect()
    assert [[c.key for c in r.citations] for r in found] == [["zheng"], ["li"], [""], ["o'neil"], ["root"]]
    assert found[2].citations[0].external and found[3].clause == "CD25 [O'Neil] · Treg"
    pairs = {(r.citation, r.file) for r in parsing.appendix(docs, "id", "md").collect()}
    assert pairs == {("zheng", "zheng_evidence.md"), ("zheng", "zheng2_evidence.md"), ("li", "li_evidence.md")}


def test_loose_json_and_title(spark):
    assert one(spark, parsing.loose_json(F.col("a")), a='```json\n{"x": {"y": 1}}\n``` done') == '{"x": {"y": 1}}'
    assert one(spark, parsing.loose_json(F.col("a")), a="none") is None
    assert one(spark, parsing.html_title(F.col("a")), a="<TITLE lang='x'>\n A &amp; B </title>") == "A & B"


# schedule


@pytest.mark.parametrize(
    ("expr", "when", "want"),
    [
        ("0 7 * * mon", "2024-01-01 07:00", True), ("0 7 * * 0", "2024-01-07 07:00", True), ("0 7 * * 7", "2024-01-07 07:00", False), ("*/15 * * * *", "2024-01-01 00:45", True), ("5/15 * * * *", "2024-01-01 00:20", False),
        ("0 0 13 * fri", "2024-09-13 00:00", True), ("0 0 13 * fri", "2024-09-06 00:00", False), ("1-5,10 * * jan,mar *", "2024-03-01 00:10", True), ("22-2 * * * *", "2024-01-01 00:23", False),
    ],
)
def test_cron(spark, expr, when, want):
    assert one(spark, schedule.matches(expr, F.to_timestamp(F.col("a"))), a=when) is want


def test_recent_tick_and_catch_up(spark):
    now = F.to_timestamp(F.lit("2024-01-03 10:30:20"))
    assert one(spark, schedule.recent_tick("0 7 * * mon", now)) == dt.datetime(2024, 1, 1, 7)
    assert one(spark, schedule.recent_tick("0 7 31 2 *", now)) is None
    stamp = lambda x: None if x is None else dt.datetime.fromisoformat(x)
    rows = [("new", "2024-01-01 07:00", None, True), ("missed", "2024-01-01 07:00", "2023-12-20 00:00", True), ("done", "2024-01-01 07:00", "2024-01-01 07:01", True), ("off", "2024-01-01 07:00", None, False)]
    df = spark.createDataFrame([(n, stamp(a), stamp(b), e) for n, a, b, e in rows], "name string, recent timestamp, last_fired timestamp, enabled boolean")
    assert {r.name: r.action for r in schedule.due(df, now).collect()} == {"new": "start", "missed": "fire", "done": "wait", "off": "wait"}


# triage, evidence, graph


def test_triage_spends_no_call_on_blank_abstracts(spark):
    papers = spark.createDataFrame([(1, "t", "good text", None), (2, "t", " ", None), (3, "t", "x", "RELEVANT"), (4, "t", "bad", None)], "id int, title string, abstract string, triage_label string")

    def model(prompt):
        abstract = prompt.rsplit("ABSTRACT: ", 1)[1]
        if not abstract.strip():
            raise AssertionError("called for a blank abstract")
        return "RELEVANT 0.9" if "good" in abstract else "NOT_RELEVANT"

    got = {r.id: (r.label, r.score, r.status) for r in triage.triage(papers, "focus", model).collect()}
    assert got == {1: ("RELEVANT", 0.9, "kept"), 2: ("BORDERLINE", 0.3, "dropped"), 4: ("NOT_RELEVANT", 0.1, "dropped")}


def test_best_passage_takes_the_first_of_equals(spark):
    chunks = spark.createDataFrame([(1, 0, "nothing here"), (1, 1, "alpha beta"), (1, 2, "beta alpha")], "doc int, pos int, passage string")
    claims = spark.createDataFrame([(1, 9, "alpha beta gamma")], "doc int, claim_id int, claim string")
    assert [(r.pos, r.shared) for r in evidence.best_passage(claims, chunks, "claim_id", "claim", ["doc"]).collect()] == [(1, 2)]


def brute_caps(rows, pm, pa, most):
    used, out = {}, []
    for key, m, a, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(out) < most and used.get(("m", m), 0) < pm and used.get(("a", a), 0) < pa:
            used["m", m], used["a", a] = used.get(("m", m), 0) + 1, used.get(("a", a), 0) + 1
            out.append(key)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_quotas_interact(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(8), rng.randrange(8), float(rng.randrange(20))) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, m int, a int, score double")
    for pm, pa, most in ((2, 3, 100), (5, 2, 7), (1, 1, 100)):
        got = graph.rank_with_caps(df, [F.desc("score"), F.col("id")], "m", "a", pm, pa, most).orderBy("rank").collect()
        assert [r.id for r in got] == brute_caps(rows, pm, pa, most) and [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_motifs(spark):
    e = lambda rows: spark.createDataFrame(rows, "edge_id int, src string, dst string, sign int, confidence double")
    a, b = e([(1, "p", "m", 1, 1.0)]), e([(2, "m", "s", 1, 1.0), (3, "m", "t", 0, 1.0)])
    known = e([(4, "p", "t", 1, 1.0)])
    assert [tuple(r) for r in graph.two_hop(a, b, known).collect()] == [("p", "s", "m")] or [(r.src, r.mid, r.dst) for r in graph.two_hop(a, b, known).collect()] == [("p", "m", "s")]
    d, q = e([(1, "d", "g", 1, 1.0), (2, "d", "h", 0, 1.0)]), e([(3, "x", "g", -1, 1.0), (4, "y", "g", 1, 1.0), (5, "z", "h", -1, 1.0)])
    assert [(r.dst, r.a_src, r.b_src) for r in graph.opposite(d, q).collect()] == [("g", "d", "x")]
    genes = [(k, "p", f"g{k}", 1 if k < 3 else -1, 0.5) for k in range(4)] + [(9, "p", "g3", 1, 0.9)] + [(20 + k, "q", f"g{k}", 1 if k < 2 else -1, 1.0) for k in range(4)]
    members = spark.createDataFrame([(f"g{k}", "sig") for k in range(4)], "member string, set string")
    assert [(r.src, r.n, r.up, r.direction, r.support) for r in graph.consolidate(e(genes), members).collect()] == [("p", 4, 4, "increase", 4)]  # a half is no majority
    cand = spark.createDataFrame([("k", 2, "late", ["b", "c"]), ("k", 1, "first", ["a", "b"])], "key string, pos int, claim string, support array<string>")
    assert [(r.claim, r.support) for r in graph.dedup(cand, ["key"], "pos", ["support"]).collect()] == [("first", ["a", "b", "c"])]


def test_ancestors_stop_at_cycles(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", None)], "c string, p string")
    got = {(r.node, r.ancestor): r.distance for r in graph.ancestors(tree, "c", "p").collect()}
    assert got[("x", "y")] == 1 and got[("a", "c")] == 2 and ("a", "a") not in got


@pytest.mark.parametrize(
    ("quote", "source", "want"),
    [("Die Straße", "die  straße war", True), ("DIE STRASSE", "die straße war", False), ("STRAßE", "Straße", True), ("İstanbul", "i̇stanbul", True), ("ﬁne", "fine", False), ("", "x", False), (None, "x", False), ("x", None, False)],
)
def test_quotes_are_compared_in_lower_case_without_folding(spark, quote, source, want):
    """Letters whose upper case is longer are not folded: ``ß`` is no ``ss``, a ligature no two letters."""
    row = spark.createDataFrame([(quote, source)], "q string, s string").select(text.quote_in_source(F.col("q"), F.col("s")).alias("x")).first()
    assert row.x is want
