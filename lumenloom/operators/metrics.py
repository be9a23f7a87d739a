"""Evaluation metrics: confusion counts, agreement, one-to-one matching, resampling, ranked retrieval."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as a double; ``empty`` for a zero denominator."""
    found = F.try_divide(a.cast("double"), b.cast("double"))
    return found if empty is None else F.coalesce(found, F.lit(empty))


def confusion(gold: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn and n as aggregates over two boolean columns."""
    count = lambda c, n: F.count_if(c).alias(n)
    return [count(gold & predicted, "tp"), count(~gold & predicted, "fp"), count(gold & ~predicted, "fn"), count(~gold & ~predicted, "tn"), F.count(F.lit(1)).alias("n")]


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """Precision, recall and F1 from counts; 0 for zero denominators."""
    t, f, m = F.col(tp), F.col(fp), F.col(fn)
    return [ratio(t, t + f).alias("precision"), ratio(t, t + m).alias("recall"), ratio(2 * t, 2 * t + f + m).alias("f1")]


def micro_macro(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From counts by key: one micro row (sums, then scores) and one macro row (mean of the keys' scores)."""
    by = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select("*", *prf())
    micro = by.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro").alias("scope"), *prf())
    macro = by.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("macro").alias("scope"), "precision", "recall", "f1")
    return micro.unionByName(macro)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns: n, po, pe, kappa (1 where pe is 1). One pass to a table of label pairs."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(a).cast("string").alias("label")), F.struct(F.lit("b").alias("side"), F.col(b).cast("string").alias("label"))))
    marginal = cells.select("n", sides.alias("x")).groupBy("x.label").agg(F.sum(F.when(F.col("x.side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.side") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = marginal.agg(F.sum(F.col("na").cast("double") * F.col("nb").cast("double")).alias("products"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a).cast("string") == F.col(b).cast("string"), F.col("n")).otherwise(0)).alias("same"))
    both = total.crossJoin(chance)  # one row each
    n = F.col("n").cast("double")
    scored = both.select("n", ratio(F.col("same"), F.col("n")).alias("po"), F.coalesce(F.try_divide(F.col("products"), n * n), F.lit(0.0)).alias("pe"))
    return scored.withColumn("kappa", F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.lit(1.0)))


def keep_all_f1(share: Column) -> Column:
    """F1 of keeping everything where ``share`` is relevant."""
    return F.coalesce(F.try_divide(2 * share, share + 1), F.lit(0.0))


def maximum_matching(gold: Sequence[Iterable[str]], found: Iterable[str], match: Callable[[str, str], bool]) -> dict[str, int]:
    """Most one-to-one pairs of predictions and concepts (any spelling counts): tp, fp, fn.

    Layered augmentation (Hopcroft and Karp): breadth-first layers, then disjoint shortest paths.
    """
    concepts, items = sorted({tuple(sorted(g)) for g in gold}), sorted(set(found))
    near = [[j for j, names in enumerate(concepts) if any(match(p, a) for a in names)] for p in items]
    of_item, of_concept = [-1] * len(items), [-1] * len(concepts)
    while True:
        layer, queue = {i: 0 for i, j in enumerate(of_item) if j < 0}, [i for i, j in enumerate(of_item) if j < 0]
        free = False
        for i in queue:
            for j in near[i]:
                k = of_concept[j]
                if k < 0:
                    free = True
                elif k not in layer:
                    layer[k] = layer[i] + 1
                    queue.append(k)
        if not free:
            break
        grown = 0
        for root in [i for i, j in enumerate(of_item) if j < 0]:
            stack, path = [(root, iter(near[root]))], []
            while stack:
                i, options = stack[-1]
                for j in options:
                    k = of_concept[j]
                    if k < 0 or layer.get(k) == layer.get(i, -2) + 1:
                        path.append((i, j))
                        if k < 0:
                            for a, b in path:
                                of_item[a], of_concept[b] = b, a
                            grown, stack = grown + 1, []
                        else:
                            stack.append((k, iter(near[k])))
                        break
                else:
                    layer.pop(i, None)
                    stack.pop()
                    if path:
                        path.pop()
        if not grown:
            break
    tp = sum(j >= 0 for j in of_item)
    return {"tp": tp, "fp": len(items) - tp, "fn": len(concepts) - tp}


def match_groups(rows: DataFrame, keys: list[str], gold: str, found: str, match: Callable[[str, str], bool]) -> DataFrame:
    """tp, fp, fn for each row: ``gold`` array<array<string>>, ``found`` array<string>. A group is one row, so nothing is shuffled."""

    def run(batches):
        for pdf in batches:
            counts = [maximum_matching(g if g is not None else [], p if p is not None else [], match) for g, p in zip(pdf[gold], pdf[found], strict=True)]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(counts, columns=["tp", "fp", "fn"])], axis=1)

    kinds = dict(rows.dtypes)
    return rows.select(*keys, gold, found).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "tp long, fp long, fn long"]))


def bootstrap(values: Sequence[float], rounds: int = 20_000, seed: int = 0) -> tuple[float, float, float]:
    """Mean and the 2.5 % and 97.5 % index percentiles of resampled means."""
    if not values:
        return float("nan"), float("nan"), float("nan")
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(rounds))
    return sum(values) / n, means[int(rounds * 0.025)], means[min(rounds - 1, int(rounds * 0.975))]


def paired_bootstrap(a: Sequence[float], b: Sequence[float], rounds: int = 20_000, seed: int = 0) -> tuple[float, float, float, float]:
    """Mean difference, its percentiles, and the share of resamples in which a is greater."""
    gaps = [x - y for x, y in zip(a, b, strict=True)]
    rng, n = random.Random(seed), len(gaps)
    means = sorted(sum(rng.choices(gaps, k=n)) / n for _ in range(rounds))
    return sum(gaps) / n, means[int(rounds * 0.025)], means[min(rounds - 1, int(rounds * 0.975))], sum(m > 0 for m in means) / rounds


def bootstrap_groups(rows: DataFrame, key: str, value: str, rounds: int = 20_000, seed: int = 0) -> DataFrame:
    """Bootstrap interval of the mean for each key, over a histogram of values, so that a group may be any size.

    A resample of n values is a multinomial draw over the distinct values; values are few (labels, scores
    rounded to a scale), rows may be many.
    """
    import numpy as np

    histogram = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        n = int(pdf["n"].sum())
        draws = np.random.default_rng(seed).multinomial(n, pdf["n"] / n, size=rounds) @ pdf["v"].to_numpy() / n
        draws.sort()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [n], "mean": [float((pdf["n"] * pdf["v"]).sum() / n)], "low": [draws[int(rounds * 0.025)]], "high": [draws[int(rounds * 0.975)]]})

    kind = dict(rows.dtypes)[key]
    return histogram.groupBy(key).applyInPandas(run, f"{key} {kind}, n long, mean double, low double, high double")


def reciprocal_ranks(ranks: DataFrame, rank: str, k: int) -> DataFrame:
    """n, mrr and recall_at_k of first-hit ranks (null: no hit)."""
    hit = F.coalesce(F.try_divide(F.lit(1.0), F.col(rank).cast("double")), F.lit(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("mrr"), F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0).cast("double")).alias("recall_at_k"))


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, population deviation, least, greatest and range by key."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.max(v) - F.min(v)).alias("range"))


def rotated(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row of a key with the next one's value, the last with the first's."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(f"next_{value}", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))
