"""Cross-site line removal by distinct-site spread.

The spread of a line is the number of different sites it stands on. It is counted by a HyperLogLog
sketch for each line hash, merged by aggregation; where the sketch's estimate comes near the threshold
the exact number of distinct sites decides. A line of at least ``min_words`` words whose spread reaches
the threshold is boilerplate; it stays in the first document that holds it and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import BROADCAST_ROWS, SPACE_CLASS, fresh, materialize, small_side

#: log2 of the sketch's buckets: a relative error of about 1.04 / sqrt(256) = 6.5 %.
SKETCH_BITS = 8
#: Estimates within this factor of the threshold, either way, are counted exactly (over 7 errors wide).
NEAR = 2.0


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version (of the text), site, pos, h1, h2 for every line of at least ``min_words`` words (128 bits of the trimmed line)."""
    several = rf"^{SPACE_CLASS}*([^{SPACE_CLASS[1:-1]}]+{SPACE_CLASS}+){{{min_words - 1}}}[^{SPACE_CLASS[1:-1]}]"
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), "site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(several)).withColumn("line", _trimmed(F.col("line")))
    return lines.select("doc_id", "version", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("wide"), "line").alias("h2"))


def spread(lines: DataFrame, threshold: int, sketch_bits: int = SKETCH_BITS, near: float = NEAR) -> DataFrame:
    """h1, h2 of the lines whose spread is at least ``threshold``, as a written table; ``lines``: h1, h2, site (null: no site).

    A line that occurs fewer times than the threshold cannot reach it and gets no sketch.
    """
    often = lines.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= threshold).select("h1", "h2")
    often = materialize(often, "often")
    again = lines.where("site IS NOT NULL").join(small_side(often), ["h1", "h2"], "left_semi").select("h1", "h2", "site")
    sketch = again.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(sketch_bits)).alias("sketch"))
    sized = sketch.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"))
    sure = sized.where(F.col("estimate") > near * threshold).select("h1", "h2")
    unsure = sized.where((F.col("estimate") <= near * threshold) & (F.col("estimate") >= threshold / near)).select("h1", "h2")
    # filtered where the rows are and made distinct before they move, so a hot line sends a row a site and task
    pairs = again.join(small_side(materialize(unsure, "unsure")), ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    return materialize(sure.unionByName(exact.where(F.col("sites") >= threshold).select("h1", "h2")), "spread")


def remove_boilerplate(docs: DataFrame, site: str = "source", threshold: int = 5, min_words: int = 4, broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of ``docs``, ``text`` without boilerplate lines, and n_lines, n_removed (long).

    A boilerplate line stays in the document of the smallest doc_id that holds it (there every time it
    occurs), so the last copy of a passage is never lost. Other lines keep their place, blank ones
    included. Null text stays null with no line; rows without site or doc_id count no site and lose
    nothing; columns named n_lines or n_removed are replaced. Texts only move between tasks where the lines to
    remove are more than ``broadcast``.
    """
    base = docs.drop("n_lines", "n_removed")
    wanted = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.col("text").cast("string").alias("text"))
    lines = materialize(_lines(wanted.where("doc_id IS NOT NULL"), min_words), "lines")
    common = small_side(spread(lines, threshold), broadcast)
    first = lines.join(common, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    # occurrences of a line, however many, stay where they are and meet a row for each boilerplate line
    gone = lines.join(small_side(materialize(first, "first"), broadcast), ["h1", "h2"]).where("doc_id > first")
    doc, version, at, parts, ends = (fresh(base.columns, x) for x in ("gone_doc", "gone_version", "gone_at", "gone_parts", "gone_ends"))
    gone = gone.groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version)).agg(F.array_sort(F.collect_set("pos")).alias(at))
    gone = materialize(gone, "gone")
    if (gone.agg(F.sum(F.size(at))).first()[0] or 0) <= broadcast:
        gone = F.broadcast(gone)
    joined = base.join(gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version)), "left")
    joined = joined.withColumn(parts, F.split("text", "\n")).withColumn(ends, F.concat(F.array(F.lit(-1)), at, F.array(F.size(parts))))
    # the runs of lines between removed ones
    runs = F.expr(f"flatten(transform(sequence(1, size({ends}) - 1), i -> slice({parts}, {ends}[i - 1] + 2, {ends}[i] - {ends}[i - 1] - 1)))")
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(runs, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines")
    n_removed = F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long").alias("n_removed")
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in base.columns], n_lines, n_removed)
