"""Product codes of integer vectors: equal parts are counted once, Lloyd's rounds run over weighted distinct parts.

Components become floor(1024 * x), vectors are cut into consecutive parts, and each part position has a
codebook of its own. Equal parts of a position are one row with a weight (how often they occur), so that a
round assigns and sums every distinct part once, however often it repeats. Codes and errors are then joined
back to the vectors by part. All arithmetic is in integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import join_hot, materialize, python_ready

#: Integer steps of one unit.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Integers beyond it count as it; an error beyond the largest long counts as that.
FAR = 1 << 60
LARGEST = (1 << 63) - 1

#: One codebook for each part position, entries by components.
Books = tuple[np.ndarray, ...]


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), x.cast("double") * SCALE))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def cuts(width: int, parts: int = PARTS) -> list[int]:
    """Where consecutive parts begin and end; they are equal where ``parts`` divides ``width``."""
    return [k * width // parts for k in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row of ``x``; ties go to the lower index. Exact."""
    reach = max((int(abs(a).max()) for a in (x, book) if a.size), default=0)
    room = 4 * max(x.shape[1], 1) * reach * reach
    kind = np.float64 if room < 1 << 53 else np.int64 if room < 1 << 62 else object
    x, book = x.astype(kind), book.astype(kind)
    apart = (book * book).sum(axis=1) - 2 * (x @ book.T)
    index = apart.argmin(axis=1)
    return index, apart[np.arange(len(x)), index] + (x * x).sum(axis=1)


def _by_position(batch: pa.RecordBatch, books: Books) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch there, their parts)."""
    position, part = batch.column("position").to_numpy(), batch.column("part")
    for k, book in enumerate(books):
        at = np.flatnonzero(position == k)
        if len(at):
            yield k, at, part.take(pa.array(at)).flatten().to_numpy().reshape(len(at), book.shape[1])


def improve(distinct: DataFrame, books: Books) -> Books:
    """One round of Lloyd's over ``distinct`` (position, part, weight): every entry becomes the floor of its parts' mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task holds is as large as the codebooks
        total = [np.zeros(b.shape, object) for b in books]
        weight = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            heavy = batch.column("weight").to_numpy()
            for k, at, x in _by_position(batch, books):
                index, _ = nearest(x, books[k])
                w = heavy[at]
                fits = int(abs(x).max(initial=0)) * int(w.sum()) < 1 << 62
                used, where = np.unique(index, return_inverse=True)
                part = np.zeros((len(used), x.shape[1]), np.int64 if fits else object)
                np.add.at(part, where, x.astype(part.dtype) * w[:, None].astype(part.dtype))
                total[k][used] += part
                np.add.at(weight[k], index, w)
        rows = [(k, int(e), d, Decimal(int(total[k][e, d])), int(weight[k][e])) for k, b in enumerate(books) for e in np.flatnonzero(weight[k]) for d in range(b.shape[1])]
        names = ("position", "entry", "at", "total", "weight")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))

    found = distinct.mapInArrow(sums, "position int, entry int, at int, total decimal(38,0), weight long")
    found = found.groupBy("position", "entry", "at").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    better = tuple(b.copy() for b in books)
    for r in found.collect():  # one row a component of the codebooks at most
        better[r["position"]][r["entry"], r["at"]] = int(r["total"]) // r["weight"]
    return better


def assign(distinct: DataFrame, books: Books) -> DataFrame:
    """``distinct`` with the code (index of the nearest entry) and error (squared distance) of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for k, at, x in _by_position(batch, books):
                code[at], far = nearest(x, books[k])
                error[at] = np.minimum(far, LARGEST) if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("position", "part", "weight")), pa.array(code), pa.array(error)], names=["position", "part", "weight", "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<long>, weight long, code int, error long")


def digest(books: Books) -> str:
    """sha256 of all entries' components by part, entry and position within the part, in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """Codes of the rows of ``vectors`` (vec_id, label and the vector column; others are not read), and the codebooks.

    Columns: vec_id, label, code (two hex digits a part), error (long). Codebooks start as the parts of the
    ``entries`` least vec_ids (nulls last; of one id the lesser vector first), and unused entries stay.
    Rows whose vector is null or has a null or non-finite component are left out. The first vector's length
    is that of the codebooks; a vector of another length has a null code and error. Rows that repeat, or
    share an id, are rows of their own. An empty table gives no row and empty codebooks.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    usable_rows = vectors.where(usable(F.col(vector))).select("vec_id", "label", integers(F.col(vector)).alias("x"))
    rows = materialize(usable_rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    width = len(first[0]["x"]) if first else 0
    at = cuts(width, parts)
    taken = [r["x"] for r in first if len(r["x"]) == width]
    start = np.array(taken, np.int64).reshape(len(taken), width)  # also without rows
    books: Books = tuple(start[:, a:b] for a, b in zip(at, at[1:], strict=False))

    pieces = F.array(*[F.slice("x", a + 1, b - a) for a, b in zip(at, at[1:], strict=False)])
    cut = rows.where(F.size("x") == width).select("row", "vec_id", "label", F.posexplode(pieces).alias("position", "part"))
    distinct = materialize(cut.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds):
        books = improve(distinct, books)
    coded = materialize(assign(distinct, books), "coded-parts")

    by_part = coded.select(F.struct("position", "part").alias("key"), "code", "error", "weight")
    met = join_hot(cut.select("row", "vec_id", "label", F.struct("position", "part").alias("key")), by_part, "key", "weight")
    codes = F.array_sort(F.collect_list(F.struct(F.col("key.position").alias("position"), "code")))  # one element a part
    error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    whole = met.groupBy("row", "vec_id", "label").agg(codes.alias("codes"), error.alias("error"))
    text = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c["code"]), 2, "0"))), "")
    other = rows.where(F.size("x") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return whole.select("vec_id", "label", text.alias("code"), "error").unionByName(other), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (label, error) with label_error: the error summed over the rows of a label, null labels together."""
    marked = materialize(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = materialize(marked.groupBy("key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("weight")), "label-errors")
    return join_hot(marked, sums, "key", "weight").drop("key")
