"""Evidence graph as two DataFrames: motif joins, hard filters, ranking with interacting quotas.

edges: edge_id, src, dst, relation, sign (-1, 0, 1), confidence, paper_id, and whatever columns a
``compatible`` condition over two edges ``a`` and ``b`` needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.runtime import materialize, small_side


def nodes(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, pivot (in and out)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    found = ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return found.withColumn("pivot", (F.col("out_degree") > 0) & (F.col("in_degree") > 0))


def two_hop(first: DataFrame, second: DataFrame, edges: DataFrame, compatible: Column | None = None) -> DataFrame:
    """src, mid, dst of paths first(src, mid) - second(mid, dst) that ``edges`` does not have as src - dst."""
    a = first.select(F.col("src"), F.col("dst").alias("mid"), *[c for c in first.columns if c not in ("src", "dst")]).alias("a")
    b = second.select(F.col("src").alias("mid"), F.col("dst"), *[c for c in second.columns if c not in ("src", "dst")]).alias("b")
    paths = a.join(b, "mid")
    if compatible is not None:
        paths = paths.where(compatible)
    known = edges.select("src", "dst").distinct()
    return paths.select("src", "mid", "dst").distinct().join(known, ["src", "dst"], "left_anti")


def opposite(first: DataFrame, second: DataFrame, compatible: Column | None = None) -> DataFrame:
    """Pairs of edges into one target with opposite, known signs: dst, a_src, b_src, sign (of the second)."""
    a, b = first.where("sign <> 0").alias("a"), second.where("sign <> 0").alias("b")
    pairs = a.join(b, (F.col("a.dst") == F.col("b.dst")) & (F.col("a.sign") == -F.col("b.sign")))
    if compatible is not None:
        pairs = pairs.where(compatible)
    return pairs.select(F.col("a.dst").alias("dst"), F.col("a.src").alias("a_src"), F.col("b.src").alias("b_src"), F.col("b.sign").alias("sign"))


def consolidate(edges: DataFrame, members: DataFrame, least: int = 3, majority: float = 0.7) -> DataFrame:
    """Sources that move the members of a set alike: src, set, n, up, direction, support.

    ``members``: member, set. Of several edges of one member the most confident counts (ties: least edge_id).
    Needs ``least`` members and a ``majority`` of one sign.
    """
    joined = edges.where("sign <> 0").join(members, F.col("dst") == F.col("member"))
    best = joined.groupBy("src", "set", "member").agg(F.max_by("sign", F.struct("confidence", (-F.col("edge_id")).alias("e"))).alias("sign"))
    found = best.groupBy("src", "set").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sign") > 0).alias("up"))
    share = F.col("up").cast("double") / F.col("n")
    kept = found.where((F.col("n") >= least) & (F.greatest(share, 1 - share) >= majority))
    return kept.withColumn("direction", F.when(share >= 0.5, "increase").otherwise("decrease")).withColumn("support", F.when(share >= 0.5, F.col("up")).otherwise(F.col("n") - F.col("up")))


def bridge(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """Edges into a gene with the marker that measures it (gene, marker): the first marker of a gene."""
    first = markers.groupBy("gene").agg(F.min_by("marker", "pos").alias("marker"))
    return edges.join(first, F.col("dst") == F.col("gene")).drop("gene")


def dedup(candidates: DataFrame, keys: list[str], order: str, supports: list[str]) -> DataFrame:
    """The first candidate of each key, with its ``supports`` arrays united in order of appearance."""
    rest = [c for c in candidates.columns if c not in keys and c not in supports]
    first = F.min_by(F.struct(*rest), order).alias("x")
    pick = lambda c: F.array_sort(F.collect_list(F.struct(order, c)))[c]
    united = [F.array_distinct(F.flatten(pick(c))).alias(c) for c in supports]
    return candidates.groupBy(*keys).agg(first, *united).select(*keys, "x.*", *supports)


def drop_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The first failing check's reason in order; null if none fails. One expression, so the order is kept."""
    (name, failed), *rest = checks
    found = F.when(failed, name)
    for name, failed in rest:
        found = found.when(failed, name)
    return found


def reasons(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """reason, n of dropped rows, and ``kept``."""
    return rows.groupBy(F.coalesce(drop_reason(checks), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clamp(x: Column, digits: int = 4) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), digits)


def rank_with_caps(candidates: DataFrame, order: list[Column], mediator: str, anchor: str, per_mediator: int, per_anchor: int, most: int) -> DataFrame:
    """Candidates in order, each taken if neither quota of its mediator nor of its anchor is used up; with rank.

    A rejected candidate uses no quota, so two row numbers would not do: quotas interact through chains of
    candidates, and the greedy pass is one fold that holds the counters only and stops at ``most``. Of one
    (mediator, anchor) pair only a prefix can be taken, so all but the first min(quotas) of each pair are cut
    before, in parallel and exactly. ``order`` must be total.
    """
    keyed = candidates.withColumn("__m", F.col(mediator).cast("string")).withColumn("__a", F.col(anchor).cast("string"))
    first = F.row_number().over(Window.partitionBy("__m", "__a").orderBy(*order)) <= min(per_mediator, per_anchor)
    keyed = materialize(keyed.withColumn("__first", first).where("__first").drop("__first"), "ranked")
    kinds = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes)

    def run(batches):
        used_m: dict[str, int] = {}
        used_a: dict[str, int] = {}
        rank = 0
        for pdf in batches:
            keep, ranks = [], []
            for m, a in zip(pdf["__m"], pdf["__a"], strict=True):
                ok = rank < most and used_m.get(m, 0) < per_mediator and used_a.get(a, 0) < per_anchor
                keep.append(ok)
                if ok:
                    used_m[m], used_a[a], rank = used_m.get(m, 0) + 1, used_a.get(a, 0) + 1, rank + 1
                    ranks.append(rank)
            keep = pd.Series(keep, index=pdf.index, dtype=bool)
            yield pdf.loc[keep].drop(columns=["__m", "__a"]).assign(rank=pd.Series(ranks, index=pdf.index[keep], dtype="int64"))
            if rank >= most:
                return

    # the pass over the best ``take`` rows is exact for them; it is repeated over more only if they do not fill the list
    total, take = keyed.count(), 16 * most
    while True:
        done = materialize(keyed.orderBy(*order).limit(take).coalesce(1).mapInPandas(run, f"{kinds}, rank long"), "capped")
        if take >= total or done.count() >= most:
            return done
        take *= 8


def ancestors(tree: DataFrame, child: str, parent: str) -> DataFrame:
    """node, ancestor, distance (the least) of an is-a graph of any depth; a node on a cycle is no ancestor of its own.

    One join a level: pairs that are known are not followed again, so a graph with many paths costs its pairs only.
    """
    up = materialize(tree.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL AND c <> p").distinct(), "tree")
    side = small_side(up)
    last = up.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).alias("distance"))
    found = last
    while True:
        step = last.join(side, F.col("ancestor") == F.col("c")).where("p <> node").select("node", F.col("p").alias("ancestor"), (F.col("distance") + 1).alias("distance")).distinct()
        last = materialize(step.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "distance"), "level")
        if last.isEmpty():
            return found
        found = found.unionByName(last)
