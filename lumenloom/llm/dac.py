"""Directly addressable codes for token ids.

A sequence of ids is split into chunk levels. Level 0 holds the lowest ``bits[0]`` bits of every id and
a continuation bitmap; only ids with more bits go on, so level k + 1 holds a chunk for each set bit of
level k's bitmap. A rank directory holds the number of set bits before every block of 512, so the place
of an id in the next level is one directory entry and at most eight popcounted words away: any id is read without decoding
another one.

File format: Parquet rows (``segment``), each a run of documents in ascending order of id, with the
documents' ids and first positions beside one binary ``code``. All are written by Spark, so any store
that Spark reaches will do.

``code``: little-endian; u32 number of ids, u8 number of levels, then for each level u8 bits, u32
entries, chunks (u8, or u16 over 8 bits), bitmap (u64 words) and rank directory (u32 for each 512 bits).
The last level has neither bitmap nor directory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import materialize, python_ready, small_side
from lumenloom.llm.tokens import encoder

#: Bits of each level; the last level takes whatever is left of 32 bits.
LEVEL_BITS = (8, 8, 16)
#: Ids after which a segment closes (a longer document has a segment of its own).
SEGMENT_IDS = 1 << 18
_WORD, _BLOCK = 64, 512


def encode_levels(ids: np.ndarray, bits: tuple[int, ...] = LEVEL_BITS) -> bytes:
    """The code of an array of ids under 2**sum(bits)."""
    rest, out = np.asarray(ids, np.uint32), []
    for k, width in enumerate(bits):
        chunk = rest & np.uint32((1 << width) - 1)
        body = chunk.astype("<u1" if width <= 8 else "<u2").tobytes()
        level = struct.pack("<BI", width, len(rest)) + body
        higher = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        more = higher > 0
        last = k == len(bits) - 1 or not more.any()
        if not last:
            padded = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK, bool)
            padded[: len(rest)] = more
            ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, _BLOCK).sum(axis=1))])
            level += np.packbits(padded, bitorder="little").tobytes() + ranks.astype("<u4").tobytes()
        out.append(level)
        if last:
            if more.any():
                raise ValueError(f"an id needs more than {sum(bits)} bits")
            break
        rest = higher[more]
    return struct.pack("<IB", len(ids), len(out)) + b"".join(out)


class Code:
    """Reads ids from a code by position."""

    def __init__(self, code: bytes):
        self.size, levels = struct.unpack_from("<IB", code)
        self.levels, at = [], 5
        for k in range(levels):
            width, n = struct.unpack_from("<BI", code, at)
            at += 5
            kind = np.dtype("<u1" if width <= 8 else "<u2")
            chunks = np.frombuffer(code, kind, n, at)
            at += n * kind.itemsize
            words = ranks = None
            if k < levels - 1:
                blocks = -(-n // _BLOCK)
                words = np.frombuffer(code, "<u8", blocks * _BLOCK // _WORD, at)
                at += words.nbytes
                ranks = np.frombuffer(code, "<u4", blocks + 1, at)
                at += ranks.nbytes
            self.levels.append((width, chunks, words, ranks))

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``, by one chunk, bit and rank a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for width, chunks, words, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                break
            first = i // _BLOCK * (_BLOCK // _WORD)
            before = int(np.bitwise_count(words[first : i >> 6]).sum()) + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()
            i, shift = int(ranks[i // _BLOCK]) + before, shift + width
        return value

    def _rank(self, level: int, i: int) -> int:
        _, chunks, words, ranks = self.levels[level]
        if i >= len(chunks):
            return int(ranks[-1])
        first = i // _BLOCK * (_BLOCK // _WORD)
        return int(ranks[i // _BLOCK]) + int(np.bitwise_count(words[first : i >> 6]).sum()) + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive), found by rank at the two ends of each level."""
        return self._slice(0, max(0, start), min(stop, self.size))

    def _slice(self, level: int, start: int, stop: int) -> np.ndarray:
        width, chunks, words, _ = self.levels[level]
        found = chunks[start:stop].astype(np.uint32)
        if words is not None and stop > start:
            bits = np.unpackbits(words[start >> 6 : (stop + 63) >> 6].view(np.uint8), bitorder="little")[start & 63 :][: stop - start].view(bool)
            found[bits] |= self._slice(level + 1, self._rank(level, start), self._rank(level, stop)) << np.uint32(width)
        return found


_SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("code", pa.binary())])


def write_codes(docs: DataFrame, end_id: int, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode whole texts, ascending by (doc_id, text), and write them; returns the table as read from its files.

    Columns: part (an order of its own: ascending ranges of doc_id), segment (ascending within part), first
    (ids of the part before the segment), n_ids, doc_ids, starts (each document's first position in the
    segment) and code. A null or empty text is the end id alone, a null doc_id comes first, rows of equal
    doc_id and text are documents of their own, other columns are ignored, an empty table has no segment.
    """
    spark = docs.sparkSession
    python_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        number = first = held = 0
        ids_of: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        starts: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal number, first, held, ids_of, doc_ids, starts
            row = [part], [number], [first], [held], [doc_ids], [starts], [encode_levels(np.concatenate(ids_of))]
            number, first, held, ids_of, doc_ids, starts = number + 1, first + held, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, _SEGMENTS, strict=True)], schema=_SEGMENTS)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                if held and held + len(ids) + 1 > segment_ids:
                    yield close()
                ids_of += [ids.astype(np.uint32), end]
                doc_ids.append(doc_id)
                starts.append(held)
                held += len(ids) + 1
        if held:
            yield close()

    only = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # a text's beginning deals rows of one doc_id, or of none, to several tasks; its order is the text's
    by_id, by_text = F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    ordered = only.repartitionByRange(parts, by_id, F.substring("text", 1, 32).asc_nulls_first()).sortWithinPartitions(by_id, by_text)
    return materialize(ordered.mapInArrow(run, "part int, segment long, first long, n_ids long, doc_ids array<long>, starts array<long>, code binary"), "dac")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the codes."""
    python_ready(segments.sparkSession)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row a part of the writing job, so this window is as short as that job's task list
    before = sizes.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, starts = Code(row["code"]), [*row["starts"], row["n_ids"]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array([row["before"] + row["first"] + x for x in starts[:-1]], pa.int64()),
                        "n_tokens": pa.array(np.diff(starts), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(code.slice(a, b).astype("<u4", copy=False)) for a, b in pairwise(starts)], pa.int64()),
                    }
                )

    return segments.join(small_side(before), "part").select("before", "first", "n_ids", "doc_ids", "starts", "code").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, position) with the id at that position of that document; null beyond its end.

    Only the segment's rows of the wanted documents are opened, and each id is one random access.
    """
    python_ready(segments.sparkSession)
    where = segments.select("part", "segment", "n_ids", F.posexplode("doc_ids").alias("k", "doc_id"), "starts")
    where = where.select("part", "segment", "doc_id", F.col("starts")[F.col("k")].alias("a"), F.coalesce(F.get("starts", F.col("k") + 1), F.col("n_ids")).alias("b"))
    asked = wanted.select(F.col("doc_id").cast("long"), F.col("position").cast("long")).join(where, "doc_id")
    lists = asked.groupBy("part", "segment").agg(F.collect_list(F.struct("doc_id", "position", "a", "b")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, found = Code(row["code"]), row["asked"]
                got = [code[x["a"] + x["position"]] if 0 <= x["position"] < x["b"] - x["a"] else None for x in found]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x["doc_id"] for x in found], pa.int64()), "position": pa.array([x["position"] for x in found], pa.int64()), "token": pa.array(got, pa.int64())})

    return lists.join(segments.select("part", "segment", "code"), ["part", "segment"]).select("code", "asked").mapInArrow(run, "doc_id long, position long, token long")
