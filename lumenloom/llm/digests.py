"""Canonical exact digests of texts.

A text is normalised (NFKC, full case folding, NFKC again), its white space runs become one space and
the ends are trimmed; the canonical text's two xxhash64 values (the second salted first, 128 bits) name a
bucket. Where a bucket holds more than one text, their canonical bytes are compared; texts that share
a bucket but differ in bytes get a suffix, so equal digests mean equal canonical bytes.

Normalisation and folding are the JVM's own (the ICU classes that Spark ships), called by Spark SQL's
``reflect``; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import BROADCAST_ROWS, materialize, small_side

#: White space of any script (Unicode property), a run of which counts as one space.
_SPACE = r"(?U)\s+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; of null the empty text."""
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold), _SPACE, " "))


def bucket(form: Column) -> Column:
    """128 bits of a canonical text as 32 hex digits."""
    wide = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(wide(F.xxhash64(form)), wide(F.xxhash64(F.lit("wide"), form)))


def collisions(forms: DataFrame) -> DataFrame | None:
    """bucket, form and k (1, 2 ...) of every form but the first in buckets that hold different forms; None if there is none.

    ``forms`` (bucket, form) need only hold the rows of buckets that are not single. Bytes are compared
    through each bucket's least and greatest form, so a hot bucket is reduced before the shuffle.
    """
    mixed = forms.groupBy("bucket").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("bucket")
    if mixed.isEmpty():
        return None
    apart = forms.join(mixed, "bucket", "left_semi").select("bucket", "form").distinct()
    ranked = apart.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("form")) - 1)
    return materialize(ranked.where("k > 0"), "collisions")


def suffixed(name: Column, k: Column) -> Column:
    return F.when(k.isNull(), name).otherwise(F.concat(name, F.lit("-"), k.cast("string")))


def exact_groups(docs: DataFrame, bucket_of=bucket) -> DataFrame:
    """doc_id, fingerprint and group_id (smallest doc_id of equal canonical bytes).

    Null text counts as empty; a null doc_id is a row like any other and is never a group's id unless all
    the group's are null. Other columns are ignored; an empty table gives no row.
    """
    hashed = docs.select(F.col("doc_id").cast("long"), canonical(F.col("text")).alias("form")).withColumn("bucket", bucket_of(F.col("form")))
    named = materialize(hashed.select("doc_id", "bucket"), "buckets")
    shared = materialize(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared")
    apart = collisions(hashed.join(small_side(shared), "bucket", "left_semi").select("bucket", "form"))
    if apart is None:
        marked = named.withColumnRenamed("bucket", "fingerprint")
    else:
        marked = hashed.join(apart, ["bucket", "form"], "left").select("doc_id", suffixed(F.col("bucket"), F.col("k")).alias("fingerprint"))
    groups = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"))
    return marked.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id")


def followers(docs: DataFrame) -> DataFrame:
    """For every distinct doc_id, the next one in ascending order (null first; after the last, the first):
    doc_id, next_id and quarter (a quarter of the longest text of that id, in code points)."""
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).alias("quarter"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    order = materialize(ranged.select(key.alias("key"), "quarter", F.spark_partition_id().alias("part")), "order")
    # one row a range: the first id of the next range, round to the first
    heads = order.groupBy("part").agg(F.min("key").alias("head"))
    along = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    within = order.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return within.join(heads, "part").select(F.col("key.doc_id").alias("doc_id"), F.coalesce("next", "head")["doc_id"].alias("next_id"), "quarter")


def with_edits(docs: DataFrame, after: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """doc_id, text, next_id and edited (the last floor(n / 4) code points replaced by the next document's first).

    ``after``: from ``followers``. ``only``: a written table of distinct doc_ids to restrict the result to;
    up to ``BROADCAST_ROWS`` of them are broadcast, and their texts do not move. Otherwise texts are shuffled once, by
    doc_id; of the next document only the quarter that is needed moves. Of several rows of the next
    doc_id the least such head is taken.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = after.select(F.col("doc_id").alias("to"), F.col("next_id").alias("from"), "quarter")
    mine = texts
    if only is not None:
        few = only.count() <= BROADCAST_ROWS
        hint = F.broadcast if few else lambda x: x
        chosen = hint(only.select(F.col("doc_id").alias("chosen")))
        wanted = hint(wanted.join(chosen, F.col("to").eqNullSafe(F.col("chosen")), "left_semi"))  # one row for each of them
        mine = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    heads = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("from"))).select("to", "from", F.expr("substring(text, 1, CAST(quarter AS INT))").alias("head"))
    heads = heads.groupBy("to", "from").agg(F.min("head").alias("head"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("head", F.lit(1), quarter))
    return mine.join(heads, F.col("doc_id").eqNullSafe(F.col("to"))).select("doc_id", "text", F.col("from").alias("next_id"), edited.alias("edited"))


def edit_digests(docs: DataFrame, bucket_of=bucket) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Likeness is 1.0 for equal canonical bytes and 0.0 otherwise: an exact digest knows nothing between.
    Null text counts as empty; rows of one doc_id have the same next document; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    after = followers(docs)
    forms = lambda edits: edits.withColumn("form", canonical(F.col("text"))).withColumn("edited_form", canonical(F.col("edited")))
    made = forms(with_edits(docs, after)).select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), bucket_of(F.col("form")).alias("a"), bucket_of(F.col("edited_form")).alias("b"))
    made = materialize(made, "edits")
    members = made.select("doc_id", F.explode(F.array("a", "b")).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    inside = materialize(members.join(shared, "bucket", "left_semi").select("doc_id").distinct(), "inside")
    again = forms(with_edits(docs, after, inside))
    pairs = again.select("doc_id", F.explode(F.array("form", "edited_form")).alias("form")).withColumn("bucket", bucket_of(F.col("form")))
    apart = collisions(pairs.select("bucket", "form"))
    if apart is None:
        named = made.withColumnRenamed("a", "fingerprint").withColumnRenamed("b", "edited_fingerprint")
    else:
        full = forms(with_edits(docs, after))
        x, y = (apart.select(F.col("bucket").alias(f"b{i}"), F.col("form").alias(f"f{i}"), F.col("k").alias(f"k{i}")) for i in "xy")
        full = full.withColumn("a", bucket_of(F.col("form"))).withColumn("b", bucket_of(F.col("edited_form")))
        full = full.join(x, (F.col("a") == F.col("bx")) & (F.col("form") == F.col("fx")), "left").join(y, (F.col("b") == F.col("by")) & (F.col("edited_form") == F.col("fy")), "left")
        named = full.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), suffixed(F.col("a"), F.col("kx")).alias("fingerprint"), suffixed(F.col("b"), F.col("ky")).alias("edited_fingerprint"))
        named = materialize(named, "named")
    nexts = named.groupBy(F.col("doc_id").alias("follower")).agg(F.min("fingerprint").alias("next_fingerprint"))
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return named.join(nexts, F.col("next_id").eqNullSafe(F.col("follower"))).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"))
