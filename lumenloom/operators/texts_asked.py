"""What many claims ask of few long texts, answered by what the texts hold: no text is joined to a claim.

``texts`` is a written table of place (any type, each once) and text; a claim asks places for numbers, words, entities or its best sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenloom.functions import text
from lumenloom.runtime import materialize

#: Longest run of digits and points whose parts are all listed; longer ones are searched.
LISTED_RUN = 24
#: Strings that are searched in one copy of a text, and sets of words that are compared with each other at once.
SEARCHED, COMPARED = 256, 400
#: F1 values above which pairs are found by rare words, one after the other.
LEVELS = (0.8, 0.5)


def runs(texts: DataFrame) -> DataFrame:
    """place, value: the runs of digits and points."""
    return texts.select("place", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\d.]+)"), 1))).alias("value"))


def signed(texts: DataFrame) -> DataFrame:
    """place, value: the runs that a percent or per-mille sign follows, with it."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\d.])([\d.]+\s*[%‰])"), 1)
    return texts.select("place", F.explode(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))).alias("value"))


def inside(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``asked`` (place, value) whose value is a part of the lower-case text."""
    sets = asked.distinct().groupBy("place", F.pmod(F.xxhash64("value"), F.lit(1 << 30)).alias("h"), "value").count().select("place", "h", "value")
    many = sets.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / SEARCHED).alias("parts"))
    lots = sets.join(many, "place").groupBy("place", (F.col("h") % F.col("parts")).alias("lot")).agg(F.collect_list("value").alias("values"))
    found = text.bind(F.lower("text"), lambda low: F.filter("values", lambda v: F.contains(low, v)))
    return lots.join(texts.select("place", "text"), "place").select("place", F.explode(found).alias("value"))


def numbers_inside(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``asked`` (place, value; digits, perhaps with a point) whose value is a part of the text: part of a run of digits and points."""
    each = materialize(runs(texts), "runs")
    whole = materialize(asked.distinct().join(each.withColumn("held", F.lit(True)), ["place", "value"], "left"), "numbers")
    found, rest = whole.where("held").select("place", "value"), whole.where("held IS NULL").select("place", "value")
    if rest.isEmpty():
        return found
    size = F.length("value")
    starts = each.where(size <= LISTED_RUN).select("place", "value", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    parts = starts.select("place", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("at") + 1), lambda n: F.substring(F.col("value"), F.col("at"), n))).alias("value")).distinct()
    met = rest.join(parts, ["place", "value"], "left_semi")
    long = each.where(size > LISTED_RUN).groupBy("place").agg(F.array_join(F.collect_list("value"), " ").alias("text"))
    return found.unionByName(met).unionByName(inside(rest, long)).distinct()


def _cross(asked: DataFrame, sentences: DataFrame) -> DataFrame:
    """id, f1: all pairs of a place, by lots of both sides."""

    def lots(rows: DataFrame, held: Column, name: str) -> DataFrame:
        many = rows.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / COMPARED).alias("parts"))
        return rows.join(many, "place").groupBy("place", F.pmod(F.xxhash64(held), F.col("parts")).alias(f"{name}_lot")).agg(F.collect_list(held).alias(name))

    met = lots(asked, F.struct("id", "w"), "a").join(lots(sentences, F.struct("w"), "b"), "place")
    best = F.transform("a", lambda a: F.struct(a["id"].alias("id"), F.array_max(F.transform("b", lambda b: f1(a["w"], b["w"]))).alias("f1")))
    return met.select(F.inline(best)).groupBy("id").agg(F.max("f1").alias("f1"))


def f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct tokens."""
    return F.coalesce(F.try_divide(F.lit(2.0) * F.size(F.array_intersect(a, b)), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def best_f1(asked: DataFrame, texts: DataFrame, sentence: str) -> DataFrame:
    """id, f1: the best F1 of the tokens ``w`` (sorted) of ``asked`` (id, place, w) against those of any sentence of the places asked; ids without a common token may lack.

    Exact. Equal sets meet by hash. What has no equal meets by its rarest tokens, at falling levels: a pair at F1 of t
    shares t / (2 - t) of either's tokens. Only what has no pair at the least level is compared with all sentences of its places.
    """
    tokens = F.array_distinct(F.transform(F.split("text", sentence), lambda s: F.array_sort(text.tokens(s, 1))))
    sentences = materialize(texts.select("place", F.explode(tokens).alias("w")).where("size(w) > 0"), "sentences")
    asked = materialize(asked.where("size(w) > 0"), "asked")
    key = lambda df: df.withColumn("h", F.sha2(F.array_join("w", " "), 256))
    found = materialize(key(asked).join(key(sentences).select("place", "h"), ["place", "h"], "left_semi").select("id").distinct().withColumn("f1", F.lit(1.0)), "equal")
    rest = materialize(asked.join(found.select("id"), "id", "left_anti"), "unequal")
    for level in LEVELS:
        if rest.isEmpty():
            return found
        new = materialize(_near(rest, sentences.join(rest.select("place").distinct(), "place", "left_semi"), level), "near-sentences")
        found, rest = found.unionByName(new), materialize(rest.join(new.select("id"), "id", "left_anti"), "unequal")
    return found if rest.isEmpty() else found.unionByName(_cross(rest, sentences))


def _near(asked: DataFrame, sentences: DataFrame, level: float) -> DataFrame:
    """id, f1: the best F1 of those that have one of ``level`` or more."""
    share = level / (2 - level)
    a = asked.select("id", "place", "w", F.sha2(F.array_join("w", " "), 256).alias("s"))
    b = sentences.select("place", "w", F.sha2(F.array_join("w", " "), 256).alias("s"))
    seen = b.select("place", F.explode("w").alias("token")).groupBy("place", "token").agg(F.count(F.lit(1)).alias("df"))

    def rare(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select("place", "s", F.size("w").alias("n"), F.explode("w").alias("token")).distinct()
        at = F.row_number().over(Window.partitionBy("place", "s").orderBy("df", "token"))
        first = each.join(seen, ["place", "token"], "left").na.fill(0, ["df"]).withColumn("at", at)
        return first.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("place", "token", F.col("s").alias(name), F.col("n").alias(f"n_{name}"))

    pairs = rare(a, "a").join(rare(b, "b"), ["place", "token"]).where((F.col("n_a") >= F.col("n_b") * share - 1e-9) & (F.col("n_b") >= F.col("n_a") * share - 1e-9)).select("place", "a", "b").distinct()
    sets = lambda rows, name: rows.select("place", F.col("s").alias(name), F.col("w").alias(f"w_{name}")).dropDuplicates(["place", name])
    both = pairs.join(sets(a, "a"), ["place", "a"]).join(sets(b, "b"), ["place", "b"]).select("place", "a", f1(F.col("w_a"), F.col("w_b")).alias("f1"))
    best = both.where(F.col("f1") >= level).groupBy("place", F.col("a").alias("s")).agg(F.max("f1").alias("f1"))
    return a.select("id", "place", "s").join(best, ["place", "s"]).groupBy("id").agg(F.max("f1").alias("f1"))
