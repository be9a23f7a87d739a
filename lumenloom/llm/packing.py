"""Vector bin packing of training sequences by the dot-product heuristic.

An item has a demand in three dimensions: tokens, segments (one) and loss-bearing tokens. A sequence
has a capacity in each. A sequence is filled by taking, again and again, the item that fits and whose
demand has the largest dot product with what is left of the sequence, each dimension scaled by its
capacity and weighted by how scarce it is among the items.

Packing is local: every task packs windows of at most ``window`` open items as its rows stream by and
carries the items of the last, unfinished sequence into the next window, so there is no shuffle, memory
is bounded, a task that runs again gives the same sequences, and each task leaves one sequence at most
that is not full. Sequence ids are unique, not dense: task number * 2**33 + a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import python_ready
from lumenloom.llm.tokens import encoder

#: Open items that one task packs together.
WINDOW_ITEMS = 1024


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


def fill_sequences(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut_at: int = 0) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start within the item, length); every token lands exactly once.

    Each item must fit an empty sequence. With ``cut_at`` > 0 the rest of a sequence of at least so
    many tokens, which no item fits, takes the head of the largest item left; that is only allowed
    where every token bears loss or none does (an item's loss is cut in proportion).
    """
    n, capacity = len(tokens), limits.vector()
    demand = np.stack([tokens, np.ones(n), loss], axis=1).astype(np.float64) / capacity
    start, alive = np.zeros(n, np.int64), np.ones(n, bool)
    scarce = demand.sum(axis=0) / max(n, 1)
    index, out = np.arange(n), []
    while True:
        index = index[alive[index]]
        if not len(index):
            return out
        left, held, rows = np.ones(3), [], index
        while len(rows):
            rows = rows[alive[rows]]
            need = demand[rows]
            fits = (need <= left + 1e-9).all(axis=1)
            rows, need = rows[fits], need[fits]
            if not len(rows):
                break
            best = rows[int(np.argmax(need @ (left * scarce)))]
            size = round(demand[best, 0] * limits.tokens)
            held.append((int(best), int(start[best]), size))
            left = left - demand[best]
            alive[best] = False
        gap = round(left[0] * limits.tokens)
        if cut_at and gap >= cut_at and left[1] * limits.segments > 0.5:
            rest = index[alive[index]]
            if len(rest):
                best = rest[int(np.argmax(demand[rest, 0]))]
                size = round(demand[best, 0] * limits.tokens)
                share = demand[best, 2] / demand[best, 0]
                take = min(gap, size - 1, int((left[2] + 1e-9) / share) if share else gap)
                if take >= cut_at:
                    held.append((int(best), int(start[best]), take))
                    start[best] += take
                    demand[best, 0] = (size - take) / limits.tokens
                    demand[best, 2] = share * demand[best, 0]
        out.append(held)


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _pack_texts(limits: Limits, end_id: int, vocabulary: str | None, cut_at: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unit = encoder(vocabulary), min(limits.tokens, limits.loss_tokens)
        end, number = np.array([end_id], np.uint32), TaskContext.get().partitionId() << 33
        items: list[tuple] = []  # (doc_id, start, ids, ids of the document)
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal number
            at = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at))
                at += len(ids)
            number += 1

        def pack(last: bool) -> None:
            nonlocal items
            sizes = np.array([len(x[2]) for x in items], np.int64)
            done = [[(items[i][0], items[i][1] + a, items[i][2][a : a + n], items[i][3]) for i, a, n in held] for held in fill_sequences(sizes, sizes, limits, cut_at)]
            items = []
            if done and not last and sum(len(x[2]) for x in done[-1]) < unit:
                items = done.pop()
            for held in done:
                close(held)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
            rows = []

        for batch in batches:
            ids_of = enc.encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.concatenate([ids.astype(np.uint32), end])
                whole = len(ids) // unit * unit
                for a in range(0, whole, unit):
                    close([(doc_id, a, ids[a : a + unit], len(ids))])
                if whole < len(ids):
                    items.append((doc_id, whole, ids[whole:].copy(), len(ids)))
            if len(items) >= window:
                pack(last=False)
            yield from flush()
        pack(last=True)
        yield from flush()

    return run


def pack_documents(docs: DataFrame, limits: Limits = Limits(), end_id: int = 0, vocabulary: str | None = None, cut_at: int = 8, window: int = WINDOW_ITEMS) -> DataFrame:
    """Cut and pack the ids of whole documents (``doc_id``, ``text``); every id bears loss.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty
    text is the end id alone; rows with equal or null ``doc_id`` are packed as documents of their own; an
    empty table gives no row; further columns of ``docs`` are ignored.
    """
    python_ready(docs.sparkSession)
    only = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return only.mapInArrow(_pack_texts(limits, end_id, vocabulary, cut_at, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: Limits = Limits(), window: int = WINDOW_ITEMS) -> DataFrame:
    """Pack uncut instruction examples (``example_id`` string, ``tokens`` and ``loss_tokens`` integers).

    One row an example: example_id, tokens, loss_tokens, sequence_id, offset, segment. Null counts are 0.
    An example beyond a limit is kept, with null sequence_id, offset and segment; so is one of no tokens.
    """
    python_ready(examples.sparkSession)
    schema = pa.schema([("example_id", pa.string()), ("tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items = TaskContext.get().partitionId() << 33, []

        def pack(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, items
            done = fill_sequences(np.array([x[1] for x in items], np.int64), np.array([x[2] for x in items], np.int64), limits)
            carried = [] if last or not done else [items[i] for i, _, _ in done.pop()]
            rows = []
            for held in done:
                at = 0
                for segment, (i, _, size) in enumerate(held):
                    rows.append((*items[i], number, at, segment))
                    at += size
                number += 1
            items = carried
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            odd = []
            for x in zip(*(batch.column(c).to_pylist() for c in ("example_id", "tokens", "loss_tokens")), strict=True):
                (items if 0 < x[1] <= limits.tokens and x[2] <= limits.loss_tokens else odd).append(x)
            if odd:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*zip(*odd, strict=True), *[[None] * len(odd)] * 3], schema, strict=True)], schema=schema)
            if len(items) >= window:
                yield from pack(last=False)
        yield from pack(last=True)

    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("tokens", "loss_tokens")]
    return examples.select(F.col("example_id").cast("string"), *counts).mapInArrow(run, "example_id string, tokens long, loss_tokens long, sequence_id long, offset long, segment int")
