"""SimHash near-duplicates by pivot distance tables.

Reference fingerprints (pivots) are the zero fingerprint, the 64 fingerprints of one bit and 31 drawn at
random. The Hamming distances of a fingerprint to all of them are its row of the distance table. By the
triangle inequality, distances to a pivot differ by at most the distance of two fingerprints, so a pair is
discarded if any coordinate differs by more than the radius; survivors are verified bit by bit.

Against the zero pivot, the pivot of bit j is nearer by one if that bit is set and farther by one if not. With
these 64 differences in four groups, two fingerprints within two bits agree in at least two groups: pairs
are looked for only among fingerprints whose rows agree in two groups, 32 bits (six joins by key, never
all pairs). A key with more than ``hot`` different fingerprints is not compared pairwise: its fingerprints
are linked through their one-bit neighbours, which is exact, as two fingerprints are within two bits of
each other if and only if they or their neighbours at one bit meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import fresh, join_hot, materialize, python_ready, small_side
from lumenloom.operators.resolve import connected

RADIUS = 2
#: Different fingerprints under one key that are compared with each other in a task.
HOT = 512
#: Zero, each single bit, and random ones.
PIVOTS = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64), np.random.default_rng(64).integers(0, 1 << 64, 31, np.uint64)]).astype(np.uint64)
_GROUPS = tuple(combinations(range(4), 2))
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes; zero of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, shingle: int, seed: int = 0) -> np.ndarray:
    """XXH64 of a text's word shingles (A-Z lower-cased, repeats included); a shorter text is one shingle, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    of = xxhash.xxh64_intdigest
    return np.array([of(x, seed) for x in joined], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats counted), XXH64 seed 42 each."""
    return majority(shingle_hashes(text, shingle, 42))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, version (a hash of the text, null of null) and fp (long, the 64 bits)."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(found)], names=["doc_id", "version", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("version", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, version long, fp long")


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (uint64) to all pivots, one row each."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def group_keys(table: np.ndarray) -> np.ndarray:
    """For each two of the four groups, a key of the coordinates in them (relative to the zero pivot)."""
    nearer = (table[:, 1:65] < table[:, :1]).astype(np.uint8)
    group = np.packbits(nearer, axis=1, bitorder="little").view(np.uint16).astype(np.int64)
    return np.stack([(k << 32) | (group[:, a] << 16) | group[:, b] for k, (a, b) in enumerate(_GROUPS)], axis=1)


def survivors(table: np.ndarray, fps: np.ndarray, i: int, radius: int) -> tuple[np.ndarray, int]:
    """The fingerprints after the i-th that are within ``radius`` of it, and how many pairs the table left to verify."""
    near = np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= radius) + i + 1
    return near[np.bitwise_count(fps[near] ^ fps[i]) <= radius], len(near)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest for each key: what the table leaves, verified."""
    for batch in batches:
        out: list[np.ndarray] = []
        for row in batch.column("fps"):
            fps = np.sort(np.array(row.values, np.int64).view(np.uint64))
            table = distance_table(fps)
            parent = list(range(len(fps)))

            def find(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i in range(len(fps) - 1):
                for j in survivors(table, fps, i, RADIUS)[0].tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append(fps[[i, j]].view(np.int64))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links that connect exactly the fingerprints (``fp``, distinct) within two bits of each other, transitively."""
    python_ready(distinct.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            found = group_keys(distance_table(fps))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps.view(np.int64), found.shape[1])), pa.array(found.ravel())], names=["fp", "key"])

    keyed = distinct.select("fp").mapInArrow(keys, "fp long, key long")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    usual = keyed.join(counts.where(F.col("n") <= hot).select("key"), "key", "left_semi")
    buckets = usual.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = buckets.mapInArrow(_compare, "a long, b long")
    crowded = counts.where(F.col("n") > hot).select("key")
    many = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    # a centre within one bit of each: at most 65 fingerprints share one, however hot the key
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long") for k in range(64)])
    centres = many.select("fp", F.explode(F.transform(bits, lambda x: F.col("fp").bitwiseXOR(x))).alias("centre"))
    stars = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    return found.unionByName(stars).distinct()


def classes(docs: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, version, fp, root (the least fingerprint of the component) and component_id of every row, as ``near_duplicates`` has them."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    rooted = connected(links(least.select("fp"), hot))
    grouped = least.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(lowest, "root").select("fp", "root", "component_id", "n"), "components")
    return join_hot(marked, named, "fp", "n")


def near_duplicates(docs: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links of two bits or fewer).

    A text without words has fingerprint zero, linked like any other. Null and empty texts are alike; a row
    without doc_id gets a fingerprint and is linked, but its id names no component unless it has no other;
    repeated rows stay; other columns are ignored; an empty table gives no row.
    """
    return classes(docs, shingle, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component one row of the least doc_id stays.

    Of several texts of that doc_id in one component the one of the least hash stays, of rows alike in both
    the least; rows of one doc_id with texts of several components are documents of their own. Rows
    without doc_id all stay.
    """
    named = materialize(classes(docs.where("doc_id IS NOT NULL"), shingle).select("doc_id", "version", "root"), "classes")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", F.col("version").isNull().alias("none"), "version")).alias("x"))
    return keep_rows(docs, first.select("x.doc_id", "x.version"), named)


def keep_rows(docs: DataFrame, stay: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` with (doc_id, hash of the text) in ``stay`` (doc_id, version; distinct), once each, and those without doc_id.

    ``rows``: doc_id and version of every row with a doc_id. Of equal doc_id and text the least row stays.
    """
    doc, version = fresh(docs.columns, "doc"), fresh(docs.columns, "version")
    key = lambda table: table.select(F.col("doc_id").alias(doc), F.col("version").alias(version))
    same = (docs["doc_id"].cast("long") == F.col(doc)) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col(version))
    stay = materialize(key(stay), "stay")
    again = materialize(key(rows.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "repeated")
    again = again.join(stay, (again[doc] == stay[doc]) & again[version].eqNullSafe(stay[version]), "left_semi")
    out = docs.where("doc_id IS NULL")
    if again.isEmpty():
        return docs.join(small_side(stay), same, "left_semi").unionByName(out)
    again = materialize(again, "several")
    once = stay.join(again, (stay[doc] == again[doc]) & stay[version].eqNullSafe(again[version]), "left_anti")
    found = docs.join(small_side(again), same)
    whole = F.struct(*[docs[c] for c in docs.columns])
    sortable = F.struct(*[docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    several = found.select(doc, version, whole.alias("row"), sortable.alias("by")).groupBy(doc, version).agg(F.min_by("row", "by").alias("row"))
    return docs.join(small_side(materialize(once, "once")), same, "left_semi").unionByName(several.select("row.*")).unionByName(out)
