"""Mixing sources to target weights by hash-threshold histograms.

A document's place in the mix is a hash of its id, so it is the same in every run. Sizes are summed by
source and hash bucket; the cumulative sum shows in which bucket a source's budget ends; only that
boundary bucket is split into finer buckets by the next bits of the hash, and so on. What comes out is
one threshold a source and budget; a filter ``hash < threshold`` takes the documents, nothing is sorted. Budgets of
one source are nested: a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import SPACE_CLASS, fresh, materialize

#: Hash bits, and the bits that each level's histogram resolves.
HASH_BITS, LEVEL_BITS = 60, (12, 12, 36)
#: Most sources whose thresholds are broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 10_000


def place(key: Column) -> Column:
    """60 bits of the md5 of a key's text (null: empty), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def count_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0), without keeping them."""
    raw = F.coalesce(text, F.lit(""))
    cut = F.size(F.split(raw, SPACE_CLASS + "+"))
    ends = F.when(raw.rlike(f"^{SPACE_CLASS}"), 1).otherwise(0) + F.when(raw.rlike(f"{SPACE_CLASS}\\z"), 1).otherwise(0)
    return F.when(raw.rlike(f"[^{SPACE_CLASS[1:-1]}]"), cut - ends).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target for ``sizes`` (source, source_size): weights 1, 2, 3 repeating by source.

    Sources go by code point, null last. Targets share the total size by weight; none is above ``cap``
    times its source's size, and what is cut off is shared again by weight. The rest of the share is then
    ``level`` times the weight, where the sources that are cut off are those of the least cap to weight ratio.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.row_number().over(ordered) - 1) % 3 + 1).withColumn("most", F.lit(cap) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    cut = ranked.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    # from the first source that is not cut off, all share one level
    first = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull().alias("null"), "source", "level"))).over(Window.partitionBy())
    return cut.withColumn("shared", first["level"]).select("source", "source_size", F.when(F.col("open"), F.col("shared") * F.col("weight")).otherwise(F.col("most")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (source, budget and any columns; several budgets of a source are nested) with ``threshold``:
    the documents of the source with a smaller ``hash`` come nearest to the budget.

    ``sized``: source, size, hash. Each level of the histogram reads only the boundary buckets of the one
    before; the last one, within 2**-24 of a source, ends at single hash values. Each level is written.
    """
    kept = budgets.columns
    done = budgets.withColumn("low", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    rest = HASH_BITS
    for step in LEVEL_BITS:
        rest -= step
        part = sized
        if rest + step < HASH_BITS:
            boundary = done.select(F.col("source").alias("s"), F.shiftright("low", rest + step).alias("p")).distinct()
            part = sized.join(boundary, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", rest + step) == F.col("p")), "left_semi")
        histogram = part.groupBy("source", F.shiftright("hash", rest).alias("bucket")).agg(F.sum("size").cast("long").alias("words"))
        prefix = F.shiftright("bucket", step)
        runs = histogram.withColumn("upto", F.sum("words").over(Window.partitionBy("source", prefix).orderBy("bucket")))
        h = runs.select(F.col("source").alias("s"), prefix.alias("p"), "bucket", "words", "upto")
        joined = done.join(h, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("low", rest + step) == F.col("p")), "left")
        # the first bucket that reaches the budget; if none does, the end of this prefix
        at = F.col("below") + F.col("upto")
        crossing = F.min(F.when(at >= F.col("budget"), F.struct("bucket", (at - F.col("words")).alias("before"), at.alias("after")))).alias("cross")
        found = joined.groupBy(*kept, "low", "below").agg(crossing, F.coalesce(F.max("upto"), F.lit(0)).alias("all"))
        inside = F.col("cross").isNotNull()
        low = F.when(inside, F.shiftleft(F.col("cross.bucket"), rest)).otherwise(F.col("low") + F.lit((1 << (rest + step)) - 1))
        below = F.when(inside, F.col("cross.before")).otherwise(F.col("below") + F.col("all"))
        if rest:
            done = found.select(*kept, low.alias("low"), below.alias("below"))
        else:
            # the boundary hash itself is taken where that comes nearer
            nearer = inside & (F.col("cross.after") - F.col("budget") < F.col("budget") - below)
            done = found.select(*kept, F.when(nearer, low + 1).otherwise(low).alias("threshold"))
        done = materialize(done, "thresholds")
    return done


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """All columns of ``docs`` that do not clash, with size, source_size, target, copies and taken.

    size: words of the text (null: 0). A document is taken ``copies`` times: floor(target / source_size)
    times, and once more if its hash is below its source's threshold for the rest of the target. Rows of
    one doc_id stand or fall together; a null doc_id or source is a value of its own; a source without
    words has target 0 and is not taken; an empty table gives no row. Targets are found over one row a source.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    base = docs.drop(*made)
    sized = materialize(base.select("source", count_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("hash")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = source_targets(sizes, float(cap)).withColumn("whole", F.floor(ratio).cast("int")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    of, whole, threshold, place_ = (fresh(base.columns, x) for x in ("mix_source", "mix_whole", "mix_threshold", "mix_place"))
    plan = thresholds(sized, parts).select(F.col("source").alias(of), "source_size", "target", F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    # the row's own size and hash are cheap next to carrying it through a join by row
    rows = base.withColumn("size", count_words(F.col("text"))).withColumn(place_, place(F.col("doc_id")))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col(of)))
    copies = F.least(F.lit(cap), F.col(whole) + F.when(F.col(place_) < F.col(threshold), 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).select(*[F.col(f"`{c}`") for c in base.columns], *made)
