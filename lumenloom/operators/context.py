"""Biological contexts and entities: normalisation against alias tables, compatibility, rank scores.

A context is a struct of arrays species, tissue, disease, cell_type, perturbation and strings condition,
comparator, timepoint. Alias tables and ancestor closures are dimension tables, joined by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text

CONTEXT = "struct<species:array<string>,tissue:array<string>,disease:array<string>,cell_type:array<string>,perturbation:array<string>,condition:string,comparator:string,timepoint:string>"
# Weights of the rank score, and how much each evidence design counts.
WEIGHTS = {
    "grounding_score": 0.30, "context_match_score": 0.20, "measurability_score": 0.20, "evidence_design_score": 0.15, "local_nonredundancy_score": 0.10, "specificity_score": 0.05,
}
DESIGNS = {
    "interventional": 1.0, "longitudinal": 0.8, "case_control": 0.65, "cross_sectional_association": 0.45, "descriptive_marker": 0.25, "descriptive_expression": 0.25, "unknown": 0.0,
}


def species(x: Column) -> Column:
    """human before mouse; empty if neither."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(low.rlike("human|homo|patient"), "human").when(low.rlike("mouse|murine") | F.trim(low).isin("mus", "mus musculus"), "mouse").otherwise("")


def named_set(values: Column) -> Column:
    """Distinct normalised values that are not blank."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: text.normalize(v)), lambda v: v != ""))


def canonical(rows: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out`` (canonical name, or the folded name itself) and ``out``_known; ``aliases``: alias, canonical."""
    side = aliases.select(text.normalize(F.col("alias")).alias("__alias"), F.col("canonical").alias("__canonical")).dropDuplicates(["__alias"])
    joined = rows.join(side, text.normalize(F.col(name)) == F.col("__alias"), "left")
    return joined.select(*rows.columns, F.coalesce("__canonical", F.trim(text.fold_greek(F.col(name)))).alias(out), F.col("__canonical").isNotNull().alias(f"{out}_known"))


def overlap_score(a: Column, b: Column, one_empty: float, conflict: float | None) -> Column:
    """Factor of one context field: 1 if they meet, ``one_empty`` if a side is empty, ``conflict`` (null: blocked) otherwise."""
    x, y = named_set(a), named_set(b)
    clash = F.lit(None).cast("double") if conflict is None else F.lit(conflict)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), one_empty).when(F.arrays_overlap(x, y), 1.0).otherwise(clash)


def cell_score(a: Column, b: Column, a_known: Column, b_known: Column, related: Column) -> Column:
    """Of canonical cell types: equal 1, parent and child 0.6, two known strangers null (blocked), unknown 0.8 or 0.4."""
    blank = (F.trim(F.coalesce(a, F.lit(""))) == "") | (F.trim(F.coalesce(b, F.lit(""))) == "")
    both, either = a_known & b_known, a_known | b_known
    return F.when(blank, 0.8).when(text.normalize(a) == text.normalize(b), 1.0).when(both & related, 0.6).when(both, F.lit(None).cast("double")).when(either, 0.8).otherwise(0.4)


def compatibility(a: Column, b: Column, cell: Column, cross_species: bool = False, transfer: bool = False) -> Column:
    """struct(compatible, score) of two contexts; ``cell`` is a ``cell_score``. A blocked field makes them incompatible."""
    da, db = F.size(named_set(a["disease"])), F.size(named_set(b["disease"]))
    disease = F.when((da > 0) & (db > 0), overlap_score(a["disease"], b["disease"], 1.0, None)).when((da > 0) | (db > 0), 0.9).otherwise(1.0)
    product = overlap_score(a["species"], b["species"], 0.8, 0.4 if cross_species else None) * cell * disease * overlap_score(a["tissue"], b["tissue"], 0.95, 0.5 if transfer else None)
    return F.struct(product.isNotNull().alias("compatible"), F.when(product.isNotNull(), F.round(F.least(product, F.lit(1.0)), 3)).otherwise(0.0).alias("score"))


def compatible_pairs(edges: DataFrame, closure: DataFrame, key: str = "edge_id", by: str = "dst") -> DataFrame:
    """Pairs of edges (key, by, context, cell, cell_known) that share ``by`` and whose contexts may compose: a, b, score.

    ``closure``: node, ancestor. Pairs are formed within a ``by`` group only, as the motif joins need them.
    """
    side = lambda n: edges.select(F.col(key).alias(n), F.col(by).alias("__by"), F.col("context").alias(f"{n}_c"), F.col("cell").alias(f"{n}_cell"), F.col("cell_known").alias(f"{n}_known"))
    pairs = side("a").join(side("b"), "__by").where("a < b")
    kin = closure.select(F.least("node", "ancestor").alias("__x"), F.greatest("node", "ancestor").alias("__y")).distinct()
    pairs = pairs.join(kin, (F.least("a_cell", "b_cell") == F.col("__x")) & (F.greatest("a_cell", "b_cell") == F.col("__y")), "left")
    cell = cell_score(F.col("a_cell"), F.col("b_cell"), F.col("a_known"), F.col("b_known"), F.col("__x").isNotNull())
    scored = pairs.withColumn("__m", compatibility(F.col("a_c"), F.col("b_c"), cell))
    return scored.where("__m.compatible").select("a", "b", F.col("__m.score").alias("score"))


def context_match(context: Column, parent_child: Column) -> Column:
    """1.0 for a full context, 0.8 with species and cell type, less for gaps; 0.6 for a parent and child pair."""
    full = lambda c: F.size(named_set(context[c])) > 0
    sp, ct, ti, dp = full("species"), full("cell_type"), full("tissue"), full("disease") | full("perturbation")
    gaps = sum((F.when(x, 0).otherwise(1) for x in (sp, ct, ti, dp)), F.lit(0))
    return F.when(parent_child, 0.6).when(sp & ct & ti & dp, 1.0).when(sp & ct, 0.8).when(gaps >= 2, 0.4).otherwise(0.6)


def specificity(context: Column, named_readout: Column, signature: Column) -> Column:
    """Sixths of: cell type, disease or perturbation, named readout, comparator, tissue, a signature of three genes."""
    full = lambda c: F.size(named_set(context[c])) > 0
    points = [full("cell_type"), full("disease") | full("perturbation"), named_readout, F.coalesce(context["comparator"] != "", F.lit(False)), full("tissue"), signature]
    return F.round(sum((F.when(p, 1).otherwise(0) for p in points), F.lit(0)) / 6.0, 3)


def risk_penalty(flags: dict[str, Column]) -> Column:
    """Added risks, at most 0.95. ``flags``: name -> condition; unknown names are refused."""
    # Fixed values.
    risks = {
        "observational_causal": 0.25, "bridge": 0.20, "single_paper_path": 0.20, "missing_comparator": 0.15, "uncertain_mediator": 0.15, "uncertain_readout": 0.15, "no_tissue": 0.10, "single_paper": 0.10,
    }
    total = sum((F.when(c, risks[n]).otherwise(0.0) for n, c in flags.items()), F.lit(0.0))
    return F.least(total, F.lit(0.95))


def rank_score(parts: dict[str, Column], penalty: Column) -> Column:
    """Weighted sum minus the penalty, clamped to 0..1, four digits."""
    raw = sum((F.lit(w) * parts[n] for n, w in WEIGHTS.items()), F.lit(0.0)) - penalty
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def evidence_design(modes: Column) -> Column:
    """The strongest effect-bearing mode's weight; 0.25 if all are descriptive."""
    table = F.create_map(*[F.lit(x) for kv in DESIGNS.items() for x in kv])
    given = F.when(F.size(F.coalesce(modes, F.array().cast("array<string>"))) > 0, modes).otherwise(F.array(F.lit("unknown")))
    effect = F.filter(given, lambda m: ~m.isin("descriptive_marker", "descriptive_expression"))
    return F.when(F.size(effect) == 0, 0.25).otherwise(F.array_max(F.transform(effect, lambda m: F.coalesce(F.try_element_at(table, m), F.lit(0.0)))))
