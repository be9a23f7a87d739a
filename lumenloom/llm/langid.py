"""Language ID by multilingual mixture inference.

Every language is a distribution over hashed character trigrams. A document is a mixture: each of its
trigrams is drawn from one of the languages. Expectation-maximisation estimates the mixture's
proportions; the set of languages is chosen by penalised likelihood (BIC: half the log of the number of
trigrams for each language beyond the first). ``lang_pred`` is the largest proportion of the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import materialize, python_ready, small_side

#: Hashed trigrams: 2**FEATURE_BITS of them, fewer where the model (languages x trigrams) would pass MODEL_SIZE numbers.
FEATURE_BITS, MODEL_SIZE = 16, 1 << 24
#: The bounded sample of labelled documents: about so many a language, chosen by hash over all rows.
TRAIN_DOCS = 2000
ROUNDS = 15
#: Where one language and all of them are so near to each other by penalised likelihood, EM goes on.
NEARLY, MORE_ROUNDS = 8.0, 300
SMOOTHING = 0.5
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None, bits: int = FEATURE_BITS) -> np.ndarray | None:
    """Hashes of ``bits`` bits of the trigrams of lower-cased letters, runs of anything else as one space; None without a letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[cp]
    if not letter.any():
        return None
    cp = np.where(letter, cp, np.uint32(32))
    cp = np.concatenate([[32], cp, [32]]).astype(np.uint32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    cp = cp[keep]
    h = cp[:-2] * np.uint32(0x9E3779B1) ^ cp[1:-1] * np.uint32(0x85EBCA77) ^ cp[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


@dataclass(frozen=True)
class Model:
    """languages (by code point) and log probabilities, (features, languages)."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.log_p).bit_length() - 1


@dataclass(frozen=True)
class Mixture:
    """proportions by language (zero outside the chosen set), log likelihood, trigrams."""

    proportions: np.ndarray
    log_likelihood: float
    size: int
    confidence: float


def _em(p: np.ndarray, counts: np.ndarray, pi: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    n = counts.sum()
    for _ in range(rounds):
        new = pi * ((counts / (p @ pi)) @ p) / n
        done = np.abs(new - pi).max() < (1e-4 if rounds == ROUNDS else 1e-6)
        pi = new
        if done:
            break
    return pi, float(counts @ np.log(p @ pi))


def infer(model: Model, grams: np.ndarray) -> Mixture:
    """Mixture of one document's trigrams."""
    feature, counts = np.unique(grams, return_counts=True)
    log_p = model.log_p[feature].astype(np.float64)
    top = log_p.max(axis=1)
    p, counts = np.exp(log_p - top[:, None]), counts.astype(np.float64)
    n, base = int(counts.sum()), float(counts @ top)
    single = counts @ (log_p - top[:, None])
    k = int(np.argmax(single))
    best, chosen, penalty = float(single[k]), np.eye(len(single))[k], 0.5 * np.log(max(n, 2))
    likely = np.exp(single - single[k])
    confidence = float(1 / likely.sum())
    if len(single) > 1:
        full, ll = _em(p, counts, np.full(len(single), 1 / len(single)))
        rounds = ROUNDS
        if best - NEARLY < ll - penalty <= best + NEARLY:  # it hangs on the last digits of the likelihood
            rounds = MORE_ROUNDS
            full, ll = _em(p, counts, full, rounds)
        # no smaller set is likelier than all languages together
        if ll - penalty > best:
            order = np.argsort(-full, kind="stable")
            for size in range(2, len(order) + 1):
                within = order[:size]
                if ll - penalty * (size - 1) <= best:
                    break
                pi, got = _em(p[:, within], counts, full[within] / full[within].sum(), rounds) if size < len(order) else (full[within], ll)
                if got - penalty * (size - 1) > best:
                    best, chosen = got - penalty * (size - 1), np.zeros(len(order))
                    chosen[within] = pi
            if np.count_nonzero(chosen) > 1:
                confidence = float(chosen.max())
    return Mixture(chosen, base + best + penalty * (np.count_nonzero(chosen) - 1), n, confidence)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id's text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def feature_bits(languages: int) -> int:
    """Bits of a trigram's hash in a model of so many languages."""
    return max(8, min(FEATURE_BITS, (MODEL_SIZE // max(languages, 1)).bit_length() - 1))


def train(labelled: DataFrame, sample: int = TRAIN_DOCS) -> Model | None:
    """Model from whole texts of ``labelled`` (key, text, lang); None without a labelled letter.

    Every labelled row is counted; about ``sample`` rows a language, chosen by a hash of the key, are read.
    """
    spark = labelled.sparkSession
    python_ready(spark)
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = tuple(sorted(r["lang"] for r in sizes.select("lang").collect()))  # one row a language
    if not languages:
        return None
    bits = feature_bits(len(languages))
    spot = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("langid")), F.lit(1 << 30))
    chance = sizes.select("lang", (F.least(F.lit(1.0), F.lit(sample) / F.col("n")) * (1 << 30)).cast("long").alias("chance"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (grams := trigrams(text, bits)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams, minlength=1 << bits)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "feature", "n"])

    some = labelled.join(small_side(chance), "lang").where(spot < F.col("chance")).select("lang", "text").repartition(8)
    # at most MODEL_SIZE rows
    counts = some.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((1 << bits, len(languages)))
    if counts.num_rows:
        column = {lang: k for k, lang in enumerate(languages)}
        table[counts["feature"].to_numpy(), [column[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    seen = np.flatnonzero(table.sum(axis=0))
    if not len(seen):
        return None
    table = table[:, seen]
    log_p = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (1 << bits)))
    return Model(tuple(languages[k] for k in seen), log_p.astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, lang_pred, score, mixture (map of the chosen set) and fits.

    lang_pred is ``und`` and the score 0 for a null text, one without a letter, and where nothing was learned.
    score: the largest proportion, or for a single language its share of the likelihood against the other
    ones. fits: the text is likelier under its mixture than under an even draw of trigrams. Ties go to
    the language that comes first. Repeated rows and null ids are rows of their own.
    """
    python_ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64())), ("fits", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                grams = trigrams(text, model.bits) if model else None
                if grams is None:
                    rows.append((UNDETERMINED, 0.0, [], False))
                    continue
                got = infer(model, grams)
                shares = [(model.languages[k], float(got.proportions[k])) for k in np.flatnonzero(got.proportions)]
                fits = got.log_likelihood > -got.size * np.log(len(model.log_p))
                rows.append((model.languages[int(np.argmax(got.proportions))], min(1.0, got.confidence), shares, bool(fits)))
            columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)] if rows else [pa.array([], t.type) for t in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>, fits boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    Rejected: what ``predict`` calls ``und`` (null, without a letter) and texts that do not fit their mixture.
    Where nothing was learned no text can be judged, and all rows stay. Rows do not move between tasks.
    """
    if model is None:
        return docs
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                grams = trigrams(text, model.bits)
                got = None if grams is None else infer(model, grams)
                keep.append(got is not None and got.log_likelihood > -got.size * np.log(len(model.log_p)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame) -> Model | None:
    """Model from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, predict all: doc_id, held_out, lang_pred, score, mixture, fits."""
    return predict(docs, learn(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "mixture", "fits")
