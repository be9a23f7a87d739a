"""Toxicity by a classifier chain.

One linear model (L2-regularised logistic regression on the presence of words and word beginnings) for each category, in a
fixed order; each sees, besides the words, the probabilities of the categories before it. While training,
those are out-of-fold: a document's probability comes from models that never saw it, so later models
learn how far earlier ones can be trusted. The vocabulary of a model is the words that speak most for
some category, over the documents that the model is fitted on: each fold's models choose their own words without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import materialize, python_ready

#: The bounded sample of labelled rows to fit on, chosen by hash over all of them.
TRAIN_ROWS = 8_000
#: Words of a model (its size; texts are read whole), and the fewest documents of the sample one must occur in.
MAX_WORDS, MIN_DOCS = 300, 8
FOLDS = 4
RIDGE = 0.3
_WORD = re.compile(r"[^\W\d_]+")

#: Categories of the labels at hand, in chain order: (name, SQL condition over the label columns).
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 AND quality = 0"))


@dataclass(frozen=True)
class Chain:
    """Words by column; for each category the weights of words, earlier categories and the intercept, and the
    probability from which it is given."""

    words: tuple[str, ...]
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]

    def probabilities(self, present: np.ndarray) -> list[float]:
        """Category probabilities of a document that holds the words ``present`` (columns)."""
        found: list[float] = []
        for w in self.weights:
            z = w[present].sum() + w[len(self.words) : -1] @ np.array(found) + w[-1]
            found.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return found


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and their beginnings of three to six letters (marked ``*``)."""
    if not text:
        return set()
    words = set(_WORD.findall(text.lower()))
    starts = {x for w in words if len(w) > 3 for x in (w[:3], w[:4], w[:5], w[:6])[: len(w) - 3]}
    return words.union([x + "*" for x in starts])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights with the intercept last, by Newton steps, halved where they overshoot; the intercept is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    if len(x) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(x) == 0 else np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    loss = lambda w: float(np.logaddexp(0, z := x @ w.astype(np.float32)).sum() - y @ z + 0.5 * (keep * w * w).sum())
    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(x @ w.astype(np.float32))
        gradient = x.T @ (p - y) + keep * w
        curvature = (x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None])).astype(np.float64) + np.diag(keep)
        step = np.linalg.solve(curvature, gradient)
        while (after := loss(w - step)) > now + 1e-3 and np.abs(step).max() > 1e-5:
            step /= 2
        w, gain, now = w - step, now - after, after
        if gain < 1e-3:
            break
    return w


def fit_chain(words: tuple[str, ...], x: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...], chosen: dict[int | None, np.ndarray] | None = None) -> Chain:
    """Chain from presence rows ``x``, label columns in chain order and fold numbers.

    ``chosen``: columns of ``x`` for the models that leave out a fold, and under None for the final ones, whose words
    are ``words``; without it all models see all columns.
    """
    columns = lambda f: slice(None) if chosen is None else chosen[f]
    earlier, weights, limits = np.zeros((len(x), 0), np.float32), [], []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float32)
        weights.append(fit_logistic(np.hstack([x[:, columns(None)], earlier]), y).astype(np.float64))
        apart = np.zeros(len(x), np.float32)
        for f in np.unique(fold).tolist():
            features = np.hstack([x[:, columns(f)], earlier])
            w = fit_logistic(features[fold != f], y[fold != f])
            apart[fold == f] = _sigmoid(features[fold == f] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, apart[:, None]])
        limits.append(best_threshold(apart, y))
    return Chain(words, categories, tuple(weights), tuple(limits))


def best_threshold(p: np.ndarray, y: np.ndarray, default: float = 0.5) -> float:
    """The out-of-fold probability, 0.1 to 0.9, from which a category is given with the best F1."""
    grid = np.arange(0.1, 0.901, 0.05)
    hits = np.array([(y[p >= t].sum(), (p >= t).sum()) for t in grid], np.float64).reshape(-1, 2)
    f1 = 2 * hits[:, 0] / np.maximum(hits[:, 1] + y.sum(), 1)
    return float(round(grid[int(np.argmax(f1))], 2)) if f1.max() > 0 else default


def train(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, rows: int = TRAIN_ROWS) -> Chain:
    """Fit on about ``rows`` labelled documents. Documents without a label or id, and null labels, do not count.

    Several labels of one doc_id are merged by the greatest of each category; of its several texts the least counts.
    """
    python_ready(docs.sparkSession)
    names = tuple(n for n, _ in categories)
    marked = labels.where("doc_id IS NOT NULL").select("doc_id", *[F.expr(c).cast("int").alias(n) for n, c in categories]).na.drop()
    marked = marked.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    total = marked.count()
    spot = lambda salt: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30))
    some = marked.where(spot("sample") < int(min(1.0, rows / max(total, 1)) * (1 << 30)))
    # the sample is bounded, and so is its broadcast; of several texts of a doc_id the least counts
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words_of(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *names)), pa.array(found, pa.list_(pa.string()))], names=["doc_id", *names, "words"])

    shape = "doc_id long, " + ", ".join(f"{n} int" for n in names) + ", words array<string>"
    held = materialize(sample.mapInArrow(presence, shape), "toxicity-sample")
    fold = F.pmod(spot("fold"), F.lit(FOLDS)).cast("int")
    sums = [F.count(F.lit(1)).alias("df"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]]
    sizes = {r["fold"]: np.array([r["df"], *(r[c] for c in names)], np.float64) for r in held.groupBy(fold.alias("fold")).agg(*sums).collect()}
    total = sum(sizes.values(), np.zeros(1 + len(names)))
    per = materialize(held.select(F.explode("words").alias("word"), fold.alias("fold"), *names).groupBy("word", "fold").agg(*sums), "toxicity-words")

    def best(without: int | None) -> list[str]:
        """Words whose documents, but for a fold, exceed a category's share by most standard errors."""
        n, *base = total - sizes.get(without, 0)
        kept = per.where(F.lit(True) if without is None else F.col("fold") != without).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("df", *names)])
        share = [b / max(n, 1) for b in base]
        stray = F.greatest(F.lit(0.0), *[(F.col(c) - F.col("df") * F.lit(float(s))) / F.sqrt(F.col("df") * F.lit(float(max(s * (1 - s), 1e-9)))) for c, s in zip(names, share, strict=True)])
        return [r["word"] for r in kept.where(F.col("df") >= MIN_DOCS).withColumn("stray", stray).orderBy(F.desc("stray"), "word").limit(MAX_WORDS).select("word").collect()]

    by_fold = {f: best(f) for f in [None, *sorted(sizes)]}
    every = sorted(set().union(*by_fold.values()))
    column = {w: k for k, w in enumerate(every)}
    chosen = {f: np.array(sorted(column[w] for w in found), np.int64) for f, found in by_fold.items()}
    known = F.array(*[F.lit(w) for w in every]) if every else F.array().cast("array<string>")
    got = held.select("doc_id", fold.alias("fold"), *names, F.array_intersect("words", known).alias("words")).orderBy("doc_id").toArrow().to_pylist()
    x = np.zeros((len(got), len(every)), np.float32)
    for i, r in enumerate(got):
        x[i, [column[w] for w in r["words"]]] = 1
    y = np.array([[r[c] for c in names] for r in got], np.float32).reshape(len(got), len(names))
    return fit_chain(tuple(every[k] for k in chosen[None]), x, y, np.array([r["fold"] for r in got], np.int64), names, chosen)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and, for each category of the chain, p_<category> (double) and <category> (boolean).

    Whole texts are read; a null or empty text has the probabilities of a text without known words. Rows
    of equal or null doc_id are rows of their own; an empty table gives no row.
    """
    python_ready(docs.sparkSession)
    shape = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    column = {w: k for k, w in enumerate(chain.words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = column.keys()
        for batch in batches:
            rows = [chain.probabilities(np.fromiter((column[w] for w in sorted(words_of(x) & vocabulary)), np.int64)) for x in batch.column("text").to_pylist()]
            table = np.array(rows, np.float64).reshape(len(rows), len(chain.categories))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, k]) for k in range(table.shape[1]))], names=["doc_id", *(f"p_{c}" for c in chain.categories)])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)
    flag = lambda c, t: (F.col(f"p_{c}") >= t).alias(c)
    return scored.select("doc_id", *[x for c, t in zip(chain.categories, chain.thresholds, strict=True) for x in (F.col(f"p_{c}"), flag(c, t))])
