"""Evaluation of extraction, triage and summaries: counts, rates and comparisons as aggregations over result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.operators import context, frames, hypotheses, metrics, synthesis

# Fields that are scored and how, and the labels of a summary's direction.
SCORED = {"genes": "entity", "species": "entity", "cell_types": "entity", "frequencies": "number", "gating_thresholds": "number"}
DIRECTIONS = ("BENEFIT", "HARM", "NO_DIFFERENCE", "INSUFFICIENT", "MIXED")
_EMPTY = "array<string>"


def cheapest_near_best(models: DataFrame, model: str, cost: str, quality: str, within: float = 0.05) -> DataFrame:
    """``models`` with near_best (quality within ``within`` of the best), cheapest (of those) and saving (of the cheapest against the best's cost).

    One row a model; the best of equal quality is the first by name.
    """
    best = models.agg(F.max(quality).alias("__top"), F.max_by(F.col(cost), F.struct(quality, (-F.col(model)).alias("m") if dict(models.dtypes)[model] != "string" else F.lit(0).alias("m"))).alias("__paid"))
    near = models.crossJoin(F.broadcast(best)).withColumn("near_best", F.col(quality) >= F.col("__top") - within)  # one row
    least = near.agg(F.min(F.when(F.col("near_best"), F.col(cost))).alias("__least"))
    done = near.crossJoin(F.broadcast(least))
    return done.select(*models.columns, "near_best", (F.col(cost) == F.col("__least")).alias("cheapest"), F.try_divide(F.col("__paid") - F.col("__least"), F.col("__paid")).alias("saving"))


def keeps(label: Column) -> Column:
    """Whether a triage label lets a paper on: everything but NOT_RELEVANT (an unknown answer does not)."""
    return ~label.isin("NOT_RELEVANT", "UNKNOWN")


def triage_scores(answers: DataFrame, key: Sequence[str] = ("backend",)) -> DataFrame:
    """Pooled scores of answers (gold, predicted, latency_ms, cost_cents; predicted null: the call failed) by backend: three classes and KEEP."""
    said = F.coalesce("predicted", F.lit("UNKNOWN"))
    gold, kept = F.col("gold") != "NOT_RELEVANT", keeps(said)
    counts = answers.groupBy(*key).agg(*metrics.confusion(gold, kept), F.count_if(F.col("gold") == said).alias("correct3"), F.count_if(said == "UNKNOWN").alias("unknown"), F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"), F.sum(F.coalesce("cost_cents", F.lit(0.0))).alias("cost_cents"))
    return counts.select("*", metrics.ratio(F.col("correct3"), F.col("n")).alias("acc3"), *metrics.prf(), F.floor(F.try_divide(F.col("latency_ms").cast("double"), F.col("n"))).cast("long").alias("avg_ms"))


def matchable(records: DataFrame) -> DataFrame:
    """paper_id, field, found (normalised strings to match on): symbol, name, the string itself, value and unit, operator and value."""
    have = {f.name: f.dataType for f in records.schema.fields}
    keys = {
        "genes": lambda x: x["symbol"], "species": lambda x: x, "cell_types": lambda x: x["name"], "frequencies": lambda x: F.trim(F.concat_ws(" ", x["value"], x["unit"])),
        "gating_thresholds": lambda x: F.concat(F.coalesce(x["operator"], F.lit("")), F.coalesce(x["value"], F.lit(""))),
    }
    clean = lambda c, f: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast(have[c])), lambda x: synthesis.plain(F.coalesce(f(x).cast("string"), F.lit("")))), lambda s: s != ""))
    each = [F.struct(F.lit(c).alias("field"), clean(c, f).alias("found")) for c, f in keys.items() if c in have]
    return records.select("paper_id", F.inline(F.array(*each)))


def gold_items(values: Column, field: Column, normalized: bool) -> Column:
    """Gold values as lists of accepted spellings; a gene has its aliases where ``normalized``."""
    single = F.filter(F.transform(F.transform(values, lambda v: synthesis.plain(F.coalesce(v, F.lit("")))), lambda s: F.array(s)), lambda x: x[0] != "")
    if not normalized:
        return single
    return F.when(field == "genes", F.filter(F.transform(values, synthesis.aliases), lambda x: F.size(x) > 0)).otherwise(single)


def _number(a: str, b: str) -> bool:
    import re

    numbers = lambda s: sorted(re.findall(r"\d+(?:\.\d+)?", s))
    units = lambda s: {t for t in re.findall("[a-zµμ]+", s.lower()) if t not in text.QUANTITY_QUALIFIERS} | set(re.findall("[%‰:/]", s))
    if not numbers(a) and not numbers(b):
        x, y = set(re.findall("[a-z0-9]+", a.lower())), set(re.findall("[a-z0-9]+", b.lower()))
        return bool(x | y) and len(x & y) / len(x | y) >= 0.5
    return numbers(a) == numbers(b) and units(a) == units(b) and _comparison(a) == _comparison(b)


def _comparison(s: str) -> str:
    import re

    low = s.lower()
    for name, signs in (("le", "≤⩽"), ("ge", "≥⩾"), ("lt", "<"), ("gt", ">")):
        if any(c in s for c in signs):
            return name
    for name, phrases in (("le", ("up to", "at most", "no more than", "not more than")), ("ge", ("at least", "no less than"))):
        if any(p in low for p in phrases):
            return name
    words = set(re.findall("[a-z]+", low))
    return "lt" if words & {"below", "under", "less", "fewer"} else "gt" if words & {"above", "over", "greater", "more", "exceeding"} else ""


#: (family, mode) -> whether a prediction matches a spelling.
MATCHERS: dict[tuple[str, str], Callable[[str, str], bool]] = {
    ("entity", "strict"): lambda a, b: a == b, ("entity", "relaxed"): lambda a, b: a in b or b in a, ("number", "strict"): lambda a, b: a == b, ("number", "relaxed"): _number,
}


def extraction_scores(records: DataFrame, gold: DataFrame, tiers: Sequence[str] = ("strict", "normalized")) -> DataFrame:
    """paper_id, field, tier, tp, fp, fn, mined for each labelled (paper_id, field, values): the most one-to-one matches.

    A labelled paper without a record misses everything; fields without a label are not measured.
    """
    found = matchable(records)
    mined = records.select("paper_id").distinct().withColumn("mined", F.lit(True))
    joined = gold.join(found, ["paper_id", "field"], "left").join(mined, "paper_id", "left").withColumn("found", F.coalesce("found", F.array().cast(_EMPTY))).withColumn("mined", F.coalesce("mined", F.lit(False)))
    out = None
    for tier in tiers:
        for family in sorted(set(SCORED.values())):
            rows = joined.where(F.col("field").isin(*[f for f, k in SCORED.items() if k == family])).withColumn("gold", gold_items(F.col("values"), F.col("field"), tier != "strict")).withColumn("tier", F.lit(tier))
            part = metrics.match_groups(rows, ["paper_id", "field", "tier", "mined"], "gold", "found", MATCHERS[family, "strict" if tier == "strict" else "relaxed"])
            out = part if out is None else out.unionByName(part)
    return out


def extraction_report(scores: DataFrame) -> DataFrame:
    """tier, scope (field, micro or macro), field, precision, recall, f1, and counts but for macro."""
    by = scores.groupBy("tier", "field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rows = by.select("tier", F.lit("field").alias("scope"), "field", "tp", "fp", "fn", *metrics.prf())
    micro = by.groupBy("tier").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select("tier", F.lit("micro").alias("scope"), F.lit(None).cast("string").alias("field"), "tp", "fp", "fn", *metrics.prf())
    macro = rows.groupBy("tier").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select("tier", F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("field"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")], "precision", "recall", "f1")
    return rows.unionByName(micro).unionByName(macro)


def dictionary_entities(docs: DataFrame, key: str, body: str, lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """key, label, norm of every lexicon term that stands in a text between non-alphanumerics, case aside.

    Terms are alternatives of one pattern a label, so a text is read once a label however many terms there are; longer terms go
    first, and terms inside longer ones are found by a look-ahead.
    """
    import re

    found = []
    for label, terms in lexicon.items():
        either = "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in sorted(set(terms), key=lambda t: (-len(t), t)))
        inner = [t for t in set(terms) if any(t.lower() != o.lower() and t.lower() in o.lower() for o in terms)]
        hits = F.regexp_extract_all(F.col(body), F.lit(rf"(?i)(?<![A-Za-z0-9])({either})(?![A-Za-z0-9])"), 1)
        extra = [F.when(F.col(body).rlike(rf"(?i)(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])"), F.lit(t)) for t in sorted(inner)]
        every = F.concat(hits, F.array_compact(F.array(*extra))) if extra else hits
        found.append(F.struct(F.lit(label).alias("label"), F.array_distinct(F.transform(F.coalesce(every, F.array().cast(_EMPTY)), synthesis.plain)).alias("norms")))
    return docs.select(key, F.inline(F.array(*found))).select(key, "label", F.explode("norms").alias("norm"))


def entity_recall(silver: DataFrame, mined: DataFrame, sources: DataFrame, key: str, labels: Sequence[str], relaxed: bool = False) -> DataFrame:
    """key, label, n_silver, n_mine, recall, extra_rate, missed, extra: entities of a source against those of its note.

    Extra: mined, matched by none and not in the source text either. ``silver`` and ``mined``: key, label, norm; ``sources``: key, text.
    """
    sets = lambda df, name: df.groupBy(key, "label").agg(F.array_sort(F.collect_set("norm")).alias(name))
    rows = sources.select(key, synthesis.plain(F.col("text")).alias("__text"), F.explode(F.array(*map(F.lit, labels))).alias("label"))
    rows = rows.join(sets(silver, "s"), [key, "label"], "left").join(sets(mined, "m"), [key, "label"], "left")
    s, m = (F.coalesce(c, F.array().cast(_EMPTY)) for c in "sm")
    meets = (lambda a, b: F.contains(a, b) | F.contains(b, a)) if relaxed else (lambda a, b: a == b)
    covered = F.filter(s, lambda y: F.exists(m, lambda x: meets(x, y)))
    extra = F.filter(m, lambda x: ~F.exists(s, lambda y: meets(x, y)) & ~F.contains(F.col("__text"), x))
    share = lambda a, b: F.round(F.try_divide(F.size(a).cast("double"), F.size(b).cast("double")), 3)
    return rows.select(key, "label", F.size(s).alias("n_silver"), F.size(m).alias("n_mine"), share(covered, s).alias("recall"), share(extra, m).alias("extra_rate"), F.array_except(s, covered).alias("missed"), extra.alias("extra"))


def entity_recall_summary(rows: DataFrame) -> DataFrame:
    """label, mean recall and extra rate (of those that are measured), sums of entities."""
    return rows.groupBy("label").agg(F.round(F.avg("recall"), 3).alias("recall"), F.round(F.avg("extra_rate"), 3).alias("extra_rate"), F.sum("n_silver").alias("n_silver"), F.sum("n_mine").alias("n_mine"))


def sentences(body: Column, least: int = 15) -> Column:
    """Sentences of at least ``least`` characters."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(body, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def supported_fraction(claims: Column, passage: Column, verifier: Callable[[Column, Column], Column] = text.supported) -> Column:
    """Share of claims that a passage supports; null of no claims, 0 of a blank passage."""
    n = F.size(claims)
    blank = F.trim(F.coalesce(passage, F.lit(""))) == ""
    hits = F.size(F.filter(claims, lambda c: verifier(c, passage)["ok"]))
    return F.when(n == 0, F.lit(None).cast("double")).when(blank, 0.0).otherwise(hits / n)


def coverage(rows: DataFrame, gold: str, candidate: str, source: str | None = None, verifier: Callable[[Column, Column], Column] = text.supported) -> DataFrame:
    """``rows`` with recall, faithfulness, precision_gold, f1, f1_basis, n_gold, n_cand of a summary against its gold and its source."""
    g, c = sentences(F.col(gold)), sentences(F.col(candidate))
    recall = supported_fraction(g, F.col(candidate), verifier)
    faithful = F.lit(None).cast("double") if source is None else F.when(F.col(source).isNotNull(), supported_fraction(c, F.col(source), verifier))
    precise = supported_fraction(c, F.col(gold), verifier)
    done = rows.withColumn("recall", recall).withColumn("faithfulness", faithful).withColumn("precision_gold", precise)
    base = F.coalesce("faithfulness", "precision_gold")
    f1 = F.when(F.col("recall").isNull() | base.isNull(), F.lit(None).cast("double")).when(F.col("recall") + base == 0, 0.0).otherwise(2 * F.col("recall") * base / (F.col("recall") + base))
    return done.withColumn("f1", f1).withColumn("f1_basis", F.when(F.col("faithfulness").isNotNull(), "faithfulness").otherwise("precision_gold")).withColumn("n_gold", F.size(g)).withColumn("n_cand", F.size(c))


def validate_coverage(golds: DataFrame, key: str, gold: str) -> DataFrame:
    """One row: mean recall of each gold against itself, the next one and nothing; a measure that tells them apart has self over cross over empty."""
    rows = metrics.rotated(golds.withColumn("__one", F.lit(1)), "__one", key, gold)
    many = F.count(F.lit(1)).over(Window.partitionBy("__one")) > 1
    score = lambda c: supported_fraction(sentences(F.col(gold)), c)
    each = rows.select(score(F.col(gold)).alias("self"), F.when(many, score(F.col(f"next_{gold}"))).alias("cross"), score(F.lit("")).alias("empty"))
    return each.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("self", "cross", "empty")], F.count(F.lit(1)).alias("n"))


def parse_direction(answer: Column) -> Column:
    """Label of a model's answer: the first of its first four tokens, else wherever one stands."""
    up = F.regexp_replace(F.upper(F.coalesce(answer, F.lit(""))), "[^A-Z_ ]", " ")
    tokens = F.array_remove(F.split(up, r"\s+"), "")
    no = F.array_contains(F.slice(tokens, 1, 5), "DIFFERENCE")
    hits = F.filter(F.transform(F.slice(tokens, 1, 4), lambda t: F.when(t.isin(*DIRECTIONS), t).when((t == "NO") & no, "NO_DIFFERENCE")), lambda t: t.isNotNull())
    anywhere = F.coalesce(*[F.when(up.contains(d) | up.contains(d.replace("_", " ")), d) for d in DIRECTIONS], F.lit("UNKNOWN"))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), anywhere)


def model_summary(rows: DataFrame, model: str) -> DataFrame:
    """By model: n, means of the coverage scores over reviews that have them, direction agreement and kappa."""
    means = rows.groupBy(model).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("recall", "faithfulness", "f1", "precision_gold")], metrics.ratio(F.count_if(F.col("gold_dir") == F.col("cand_dir")), F.count(F.lit(1))).alias("dir_acc"))
    cells = rows.groupBy(model, "gold_dir", "cand_dir").agg(F.count(F.lit(1)).alias("k"))
    side = lambda c: cells.groupBy(model, F.col(c).alias("l")).agg(F.sum("k").alias(f"k_{c}"))
    chance = side("gold_dir").join(side("cand_dir"), [model, "l"]).where(F.col("l").isin(*DIRECTIONS)).groupBy(model).agg(F.sum(F.col("k_gold_dir") * F.col("k_cand_dir")).alias("products"))
    both = means.join(chance, model, "left")
    pe = F.coalesce(F.col("products") / (F.col("n") * F.col("n")), F.lit(0.0))
    return both.withColumn("kappa", F.when(pe < 1, (F.col("dir_acc") - pe) / (1 - pe)).otherwise(1.0)).drop("products")


def direction_confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """gold, predicted, n."""
    return rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def project_cost(configs: DataFrame, screened: int = 200, mined: int = 30, runs: int = 1, weeks: int = 52) -> DataFrame:
    """``configs`` (triage, mine, synth: dollars each) with the dollars of each step, the total of a run and of a year."""
    rows = configs.withColumn("triage_cost", F.lit(screened) * F.col("triage")).withColumn("mine_cost", F.lit(mined) * F.col("mine")).withColumn("synth_cost", F.lit(runs) * F.col("synth"))
    return rows.withColumn("total", F.col("triage_cost") + F.col("mine_cost") + F.col("synth_cost")).withColumn("yearly", F.col("total") * weeks)


def provider_tallies(calls: DataFrame, key: str = "provider") -> DataFrame:
    """Sums of tokens, cost and latency of successful calls by provider, with the mean latency."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "cached_tokens", "creation_tokens", "output_tokens", "cost_cents", "latency_ms")]
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), *sums).withColumn("avg_ms", F.floor(F.col("latency_ms") / F.col("calls")).cast("long"))


def frame_accuracy(gold: DataFrame, extracted: DataFrame, grounded: DataFrame) -> DataFrame:
    """One row: accuracy of extracted frames against gold (paper_id, statement, readout, direction, cell_type, evidence_mode, comparator, abstain).

    A gold row meets the frames of its paper and normalised statement; of several the first with its readout counts, else the first.
    """
    frames_ = extracted.join(grounded.select("frame_id", F.lit(True).alias("ok")), "frame_id", "left")
    side = frames_.select("paper_id", text.normalize(F.col("raw_statement")).alias("key"), F.struct("idx", "k").alias("at"), F.struct(text.normalize(F.col("readout.name")).alias("readout"), "direction", F.coalesce("cell.name", F.lit("")).alias("cell"), "evidence_mode", "context.comparator", F.coalesce("ok", F.lit(False)).alias("ok")).alias("p"))
    rows = gold.withColumn("gold_id", F.monotonically_increasing_id()).withColumn("key", text.normalize(F.col("statement"))).join(side, ["paper_id", "key"], "left")
    same = F.coalesce(F.col("p.readout") == text.normalize(F.col("readout")), F.lit(False))
    keep = [c for c in gold.columns if c not in ("paper_id", "statement")]
    best = rows.groupBy("gold_id", *keep).agg(F.min_by("p", F.struct((~same).alias("s"), "at")).alias("p"))
    asked, hit = ~F.coalesce("abstain", F.lit(False)), F.col("p").isNotNull()
    m = asked & hit
    right = {"readout": F.col("p.readout") == text.normalize(F.col("readout")), "direction": F.col("p.direction") == F.col("direction"), "cell_type": text.normalize(F.col("p.cell")) == text.normalize(frames.cell_name(F.col("cell_type"))), "evidence_mode": F.col("p.evidence_mode") == F.col("evidence_mode")}
    given = lambda c: m & (F.coalesce(F.col(c), F.lit("")) != "")
    compared = given("comparator")
    n = lambda c: F.count_if(c)
    return best.agg(
        F.count(F.lit(1)).alias("n_gold"), n(m).alias("matched"), *[synthesis.rate(n(given(c) & F.coalesce(r, F.lit(False))), n(given(c))).alias(f"{c}_accuracy") for c, r in right.items()],
        synthesis.rate(n(compared & F.coalesce(F.contains(text.normalize(F.col("p.comparator")), text.normalize(F.col("comparator"))), F.lit(False))), n(compared)).alias("comparator_recovery"), synthesis.rate(n(m & F.col("p.ok")), n(m)).alias("grounding_precision"),
        F.round(n(asked & ~hit) / F.greatest(n(asked), F.lit(1)), 3).alias("abstention_rate"), n(~asked & ~hit).alias("abstain_correct"), n(~asked).alias("abstain_total"),
    )


def hidden_edges(edges: DataFrame) -> DataFrame:
    """Signed edges that a two-step path also reaches: edge_id, anchor, object, direction, the targets of a recovery test."""
    known = edges.select("src", "dst").distinct()
    paths = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).where("b.dst <> a.dst").select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).distinct()
    return edges.where("sign <> 0").join(paths, ["src", "dst"], "left_semi").select("edge_id", F.col("src").alias("anchor"), F.col("dst").alias("object"), "direction")


def recover_hidden(records: DataFrame, used: DataFrame, targets: list, config: hypotheses.Config = hypotheses.Config(), k: int = 10) -> dict:
    """Recall, MRR, and direction and context of targets (frame_id, anchor, object, direction), each hidden in turn: one run a target, a gold-sized list."""
    ranks, right = [], 0
    for t in targets:
        rest = used.where(F.col("frame_id") != t["frame_id"])
        edges = frames.edges(rest)
        kept = hypotheses.judged(hypotheses.generate(edges, frames.signature_index(records), config), rest, edges, config).where("reason IS NULL")
        hit = hypotheses.rank(hypotheses.score(kept), config).where((F.col("anchor_id") == t["anchor"]) & (F.col("object") == t["object"])).orderBy("rank").select("rank", "direction").first()
        ranks.append(hit["rank"] if hit else None)
        right += bool(hit and hit["direction"] == t["direction"])
    n = len(targets)
    share = lambda x: round(x / n, 3) if n else 0.0
    found = [r for r in ranks if r]
    return {"n_targets": n, "recall@5": share(sum(r <= 5 for r in found)), f"recall@{k}": share(sum(r <= k for r in found)), "mrr": share(sum(1 / r for r in found)), "direction_correct": share(right), "context_correct": share(len(found))}


def null_models(records: DataFrame, used: DataFrame, seed: int = 0, config: hypotheses.Config = hypotheses.Config()) -> dict[str, int]:
    """Candidates of the frames as they are and with directions, contexts or modes shuffled."""
    signed = F.col("direction").isin("increase", "decrease", "association_positive", "association_negative")
    deals = {"real": used, "sign_shuffled": hypotheses.shuffled(used, "direction", "frame_id", seed, signed), "context_shuffled": hypotheses.shuffled(used, "context", "frame_id", seed), "relation_shuffled": hypotheses.shuffled(used, "evidence_mode", "frame_id", seed)}
    return {f"{name}_candidates": hypotheses.candidate_count(rows, records, config) for name, rows in deals.items()}


def take_sample(docs: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows by key, or ``n`` by a seeded hash of it; reruns agree."""
    return docs.orderBy(key if seed is None else F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def compare_models(scores: DataFrame, rounds: int = 20_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Models (model, mean, low, high, beats_keep_all) and pairs (a, b, difference, low, high, p_greater) of topic-wise scores (model, topic, keep_f1, prevalence).

    Topics are resampled; there are few, and a model's are one group.
    """
    import numpy as np
    import pandas as pd

    rows = scores.withColumn("__base", metrics.keep_all_f1(F.col("prevalence")))

    def interval(x, rng):
        means = np.sort(x[rng.integers(0, len(x), (rounds, len(x)))].mean(axis=1))
        return float(means[int(rounds * 0.025)]), float(means[min(rounds - 1, int(rounds * 0.975))]), float((means > 0).mean())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("topic")
        rng, x = np.random.default_rng(seed), pdf["keep_f1"].to_numpy(float)
        low, high, _ = interval(x, rng)
        over, _, _ = interval(x - pdf["__base"].to_numpy(float), rng)
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high], "beats_keep_all": [over > 0]})

    def two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("topic")
        x = pdf["x"].to_numpy(float)
        low, high, p = interval(x, np.random.default_rng(seed))
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "difference": [x.mean()], "low": [low], "high": [high], "p_greater": [p]})

    models = rows.groupBy("model").applyInPandas(one, "model string, mean double, low double, high double, beats_keep_all boolean")
    x, y = (scores.select(F.col("model").alias(n), "topic", F.col("keep_f1").alias(f"f_{n}")) for n in "ab")
    gaps = x.join(y, "topic").where("a < b").select("a", "b", "topic", (F.col("f_a") - F.col("f_b")).alias("x"))
    return models, gaps.groupBy("a", "b").applyInPandas(two, "a string, b string, difference double, low double, high double, p_greater double")


def study_blocks(studies: Column, most: int, chars: int) -> Column:
    """The included studies as one text: what a summary is written from and grounded in."""
    shown = F.transform(F.slice(studies, 1, most), lambda s: F.concat(F.lit("STUDY (PMID "), s["pmid"], F.lit("): "), F.coalesce(s["title"], F.lit("")), F.lit("\n"), F.substring(s["abstract"], 1, chars)))
    return F.array_join(shown, "\n\n")


def context_scores(rows: DataFrame, ctx: str = "context") -> DataFrame:
    """``rows`` with the context match and specificity parts of the rank score, for a look at contexts alone."""
    no = F.lit(False)
    return rows.withColumn("context_match", context.context_match(F.col(ctx), no)).withColumn("specificity", context.specificity(F.col(ctx), no, no))


def baseline_record(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, genes, species, cell_types, frequencies of texts by patterns and word lists alone: the floor that a model must beat."""
    # Fixed values.
    gene, gene_stop = r"\b([A-Z][A-Za-z0-9]*[0-9][A-Za-z0-9]*|[A-Z]{2,}[0-9]*)\b", ("objective", "methods", "results", "conclusion", "conclusions", "background", "dna", "rna", "mrna", "cdna", "pcr", "qt", "lqts", "atg", "gtg", "ecg", "ekg", "usa", "ii", "iii", "iv", "id", "or", "and", "wt", "ko", "sd", "ci", "hr")
    species = ("human", "humans", "patient", "patients", "man", "woman", "men", "women", "homo sapiens", "mouse", "mice", "murine", "mus musculus", "rat", "rats", "rattus", "zebrafish", "drosophila", "yeast", "newborn", "proband", "child", "children", "infant", "fetal", "fetus")
    cells = ("lymphocytes", "lymphocyte", "monocytes", "monocyte", "macrophages", "macrophage", "neutrophils", "neutrophil", "fibroblasts", "fibroblast", "granulocytes", "eosinophils", "basophils", "thymocytes", "thymocyte", "splenocytes", "leukocytes", "leukocyte", "erythrocytes", "platelets", "megakaryocytes", "hepatocytes", "keratinocytes", "myocytes", "neurons", "neuron", "osteoblasts", "osteoclasts", "pbmc", "pbmcs")
    cell = r"(?i)\b([A-Za-z][A-Za-z0-9+\-]{0,40}\s+(?:cells?|cyte|cytes|blasts?|phils?|clasts?))\b"
    quantity = r"(\d+(?:\.\d+)?\s?(?:%|°\s?[CF]|[A-Za-zµμ]+(?:\s?/\s?[A-Za-zµμ]+)?)?)"
    t = F.col(body)
    norm = lambda xs: F.transform(xs, synthesis.plain)
    listed = lambda words: F.array_compact(F.array(*[F.when(t.rlike(rf"(?i)(?<![a-z]){w}(?![a-z])"), F.lit(w)) for w in words]))
    every = lambda p: F.regexp_extract_all(t, F.lit(p), 1)
    genes = F.filter(every(gene), lambda g: ~synthesis.plain(g).isin(*gene_stop) & (F.length(synthesis.plain(g)) >= 3))
    return docs.select(key, F.array_distinct(norm(genes)).alias("genes"), F.array_sort(listed(species)).alias("species"), F.array_distinct(F.concat(listed(cells), norm(every(cell)))).alias("cell_types"), F.array_distinct(norm(every(quantity))).alias("frequencies"))


def split_quantity(x: Column) -> Column:
    """struct(value, unit) of a quantity."""
    value = F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*(.*)", 1)
    return F.struct(F.when(value != "", value).otherwise(F.trim(x)).alias("value"), F.when(value != "", F.trim(F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*(.*)", 2))).otherwise("").alias("unit"))
