"""Phrase collocations: every contiguous phrase is counted from sorted suffixes, then scored by its weakest cut.

Each word occurrence gives one suffix of its piece, cut to the longest phrase. Suffixes are shuffled by
language and first word and sorted in reverse byte order, where all suffixes that share a prefix stand
together, longer ones first; one stack of open prefixes then counts the prefixes of all lengths in a single
pass. Words are coded by rank, so that a suffix is a few bytes and a prefix of words is a prefix of bytes.

A word under the least count can be in no candidate, so pieces are cut at such words before the shuffle. A
first word that would overfill a task is dealt to several by ranges of what follows it; a prefix can then be
cut by the border of a range only if it is open there, and those partial counts are added up afterwards.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.llm.common import BROADCAST_ROWS, materialize, python_ready, small_side

LONGEST = 5
LEAST = 100
#: A candidate goes if a longer one that contains it has at least this percentage of its count.
ABSORBED = 100
TOP = 2000
UNDETERMINED = "und"

#: Most words that get a code; the others of a larger vocabulary stand for themselves in a suffix.
CODED_WORDS = BROADCAST_ROWS // 2
#: Sampled suffixes for each range of a hot word, which set the borders and nothing else.
PER_RANGE = 64
#: Rows that the stack takes at once, and distinct words that a task counts before it passes them on.
_AT_ONCE, _HELD = 1 << 15, 300_000
#: Bytes of text whose equal suffixes become one row.
_TEXT_BYTES = 1 << 22

_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_ENDS))
#: Leading bytes of codes of two, three and four bytes, which UTF-8 has nowhere, and the bytes that may follow.
_LEADS = {2: (0xC0, 0xC1, 0xF5, 0xF6, 0xF7), 3: (0xF8, 0xF9, 0xFA, 0xFB), 4: (0xFC, 0xFD, 0xFE, 0xFF)}
_NEXT = (*range(0x80, 0xC0), *range(0xC2, 0xF5))
#: What keys are filled up with to a multiple of so many bytes.
_FILL, _EVEN = b"\x80", 16
#: Bytes of the code that a byte leads, or 0.
_SIZE = np.zeros(256, np.int64)
for _n, _leads in _LEADS.items():
    _SIZE[list(_leads)] = _n


def code(k: int) -> bytes:
    """The code of the k-th word."""
    low = len(_NEXT)
    for size, leads in _LEADS.items():
        if k < len(leads) * low ** (size - 1):
            return bytes((leads[k // low ** (size - 1)], *(_NEXT[k // low**i % low] for i in range(size - 2, -1, -1))))
        k -= len(leads) * low ** (size - 1)
    raise ValueError("more words than codes")


def word_ends(data: np.ndarray) -> np.ndarray:
    """Where the words of keys end: at a code's last byte, and at the space behind a word that stands for itself."""
    ends = data == 32
    size = _SIZE[data]
    leads = np.flatnonzero(size)
    ends[leads + size[leads] - 1] = True
    return np.flatnonzero(ends)


class Codes:
    """Codes of the words of each language, most frequent first.

    A word without a code is a break between two runs where all words that count have one (``whole``); else it
    stands for itself, followed by its language's number. Either way a word's bytes end where they end, and
    say which language they are of.
    """

    def __init__(self, words: list[tuple[str, bytes]], langs: list[str], whole: bool):
        self.words, self.langs, self.whole = words, langs, whole
        self.bytes = [code(k) for k in range(len(words))]
        self.place: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(words):
            self.place.setdefault(lang, {})[word] = k + 1

    def prepare(self) -> None:
        """What only tasks need."""
        self.table = pa.array([b"", *self.bytes], pa.binary())
        self.number = {lang: k for k, lang in enumerate(self.langs)}
        self.index = {x: k for k, x in enumerate(self.bytes)}

    def read(self, key: bytes) -> tuple[str, list[bytes]]:
        """Language and words of a key, filled up or not."""
        words, lang, i = [], "", 0
        key = key[: int(word_ends(np.frombuffer(key, np.uint8))[-1]) + 1]
        while i < len(key):
            if size := int(_SIZE[key[i]]):
                lang, word = self.words[self.index[key[i : i + size]]]
                i += size
            else:
                end = key.index(b" ", i)
                word, _, number = key[i:end].partition(b"\t")
                lang, i = self.langs[int(number)], end + 1
            words.append(word)
        return lang, words


def marked_words(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a full stop where a piece ends."""
    return (text or b"").translate(_FOLD).replace(b".", b" . ").split()


def _counted(counts: dict[str, Counter[bytes]]) -> pa.RecordBatch:
    held = [(lang, found) for lang, found in counts.items() if found]
    langs = pa.array([lang for lang, found in held for _ in range(len(found))], pa.string())
    keys = pa.array([k for _, found in held for k in found], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, keys, pa.array([n for _, found in held for n in found.values()], pa.int64())], names=["lang", "word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of ``texts`` (lang, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(marked_words(text))
            if sum(map(len, counts.values())) > _HELD:
                for found in counts.values():
                    found.pop(b".", None)
                yield _counted(counts)
                counts = {}
        for found in counts.values():
            found.pop(b".", None)
        yield _counted(counts)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def coded_suffixes(langs: list[str], texts: list[bytes | None], codes: Codes, longest: int) -> tuple[pa.Array, np.ndarray]:
    """Different suffixes of the texts as keys, and how often each occurs."""
    own: dict[bytes, int] = {}
    size = len(codes.words) + 1
    found: list[np.ndarray] = []
    for lang, text in zip(langs, texts, strict=True):
        words = marked_words(text)
        at = np.fromiter(map(codes.place.get(lang, {}).get, words, itertools.repeat(0)), np.int32, len(words))
        if not codes.whole:
            mark = b"\t%d " % codes.number[lang]
            for i in np.flatnonzero(at == 0).tolist():
                if words[i] != b".":
                    at[i] = own.setdefault(words[i] + mark, size + len(own))
        found += [at, np.zeros(1, np.int32)]
    at = np.concatenate(found) if found else np.zeros(0, np.int32)
    rows = np.zeros((len(at), longest), np.int32)
    rows[:, 0] = at
    for k in range(1, longest):
        rows[:-k, k] = np.where(rows[:-k, k - 1] > 0, at[k:], 0)
    rows = rows[at > 0]
    # equal rows have equal sums of products, and stand together by them
    mixed = np.zeros(len(rows), np.uint64)
    for k, factor in enumerate(np.random.default_rng(1).integers(1, 1 << 63, longest, np.uint64)):
        mixed += rows[:, k].astype(np.uint64) * factor
    rows = rows[np.argsort(mixed, kind="stable")]
    heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(rows)))
    rows = rows[heads]
    # keys are filled up, as rows of even length are packed best by the shuffle; no word begins with the filling
    first_fill = size + len(own)
    table = pa.concat_arrays([codes.table, pa.array([*own, *(_FILL * k for k in range(1, _EVEN))], pa.binary())])
    length = np.diff(np.frombuffer(table.buffers()[1], np.int32)[: len(table) + 1])
    fill = -length[rows].sum(axis=1) % _EVEN
    rows = np.column_stack([rows, np.where(fill > 0, first_fill + fill - 1, 0)])
    joined = table.take(pa.array(rows[rows > 0]))
    ends = np.concatenate([[0], np.cumsum((rows > 0).sum(axis=1))])
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset :][ends] if len(joined) else np.zeros(1, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), joined.buffers()[2]]), times


def suffix_rows(texts: DataFrame, codes: Codes, longest: int = LONGEST, every: int = 1) -> DataFrame:
    """(key, n) of every so-manieth suffix of ``texts``, all by default; equal ones of texts that come together are one row."""
    sent = texts.sparkSession.sparkContext.broadcast(codes)  # CODED_WORDS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent.value.prepare()
        langs: list[str] = []
        texts: list[bytes | None] = []

        def given() -> pa.RecordBatch:
            keys, times = coded_suffixes(langs, texts, sent.value, longest)
            langs.clear()
            texts.clear()
            rows = pa.RecordBatch.from_arrays([keys, pa.array(times.astype(np.int64))], names=["key", "n"])
            return rows if every == 1 else rows.take(pa.array(np.arange(0, len(times), every)))

        held = 0
        for batch in batches:
            langs += batch.column("lang").to_pylist()
            texts += batch.column("text").to_pylist()
            held += batch.column("text").nbytes
            if held >= _TEXT_BYTES:
                yield given()
                held = 0
        yield given()

    return texts.mapInArrow(run, "key binary, n long")


#: The bytes by which suffixes are dealt: a first word's code or its three first bytes.
_HEAD = f"substring(key, 1, CASE WHEN substring(key, 1, 1) IN ({', '.join(f"X'{x:02X}'" for x in _LEADS[2])}) THEN 2 ELSE 3 END)"


def borders(texts: DataFrame, codes: Codes, hot: dict[bytes, int], occur: int, longest: int = LONGEST) -> dict[bytes, list[bytes]]:
    """For the code of each hot first word the suffixes at which its ranges begin, from a sample of the texts.

    ``hot``: the number of ranges of each; ``occur``: how often they all occur. Borders change how even the tasks are, not what is counted.
    """
    every = max(1, occur // (PER_RANGE * sum(hot.values())))
    within = min(every, 32)
    some = suffix_rows(texts.sample(within / every, 7) if within < every else texts, codes, longest, within)
    sampled: dict[bytes, list[bytes]] = {}
    for r in some.where(F.expr(_HEAD).isin([bytearray(x) for x in hot])).select("key").collect():  # about PER_RANGE rows a range
        key = bytes(r["key"])
        sampled.setdefault(key[: min(3, int(_SIZE[key[0]]))], []).append(key)
    found = {}
    for head, ranges in hot.items():
        held = sorted(sampled.get(head, []))
        found[head] = sorted({held[k * len(held) // ranges] for k in range(1, ranges)}) if held else []
    return found


class Stack:
    """Open prefixes of the last suffix, by number of words, with their counts so far.

    Keys come in reverse order of their bytes; those of one range (``part``) stand together. A closed prefix is
    given out if it has the least count, or if it was open at an end of a range of a hot word (``part`` 0 or
    more), whose neighbour may hold more of it.
    """

    def __init__(self, least: int, longest: int):
        self.least, self.longest = least, longest
        self.last: tuple[int, bytes] | None = None
        self.open = np.zeros(longest, np.int64)
        self.edge = np.zeros(longest, bool)
        self.out: list[tuple[bytes, int]] = []

    def take(self, keys: pa.Array, parts: np.ndarray, weights: np.ndarray) -> None:
        """Counts the keys; what is still open at their end stays so."""
        before = self.last is not None
        if self.last is not None:
            keys = pa.concat_arrays([pa.array([self.last[1]], pa.binary()), keys])
            parts, weights = np.concatenate([[self.last[0]], parts]), np.concatenate([[0], weights])
        size = len(keys)
        if not size:
            return
        start = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + size + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[start[0] : start[-1]]
        start -= start[0]
        length = np.diff(start)
        end = word_ends(data)
        first_end = np.searchsorted(end, start)
        words = np.diff(first_end)
        # words in common with the key before
        common = np.zeros(size, np.int64)
        short = np.minimum(length[1:], length[:-1])
        begin = np.concatenate([[0], np.cumsum(short)])
        within = np.arange(begin[-1]) - np.repeat(begin[:-1], short)
        differs = np.flatnonzero(data[np.repeat(start[1:-1], short) + within] != data[np.repeat(start[:-2], short) + within])
        alike = np.minimum(np.append(differs, begin[-1])[np.searchsorted(differs, begin[:-1])], begin[1:]) - begin[:-1]
        common[1:] = np.searchsorted(end, start[1:-1] + alike) - first_end[1:-1]
        # a range ends where the next one, or another first word, begins
        new = np.concatenate([[not before], (parts[1:] != parts[:-1]) | (common[1:] == 0)])
        common[new] = 0
        edge = (new | np.append(new[1:], False)) & (parts >= 0)
        for d in range(self.longest):
            has = words > d
            heads = np.flatnonzero(has & ((common <= d) | (np.arange(size) == 0)))
            if not len(heads):
                self.open[d], self.edge[d] = 0, False
                continue
            sums = np.add.reduceat(np.where(has, weights, 0), heads)
            edges = np.logical_or.reduceat(edge & has, heads)
            if before and heads[0] == 0:
                sums[0] += self.open[d]
                edges[0] |= self.edge[d]
            still = bool(has[-1])
            done = len(heads) - still
            for k in np.flatnonzero((sums[:done] >= self.least) | edges[:done]):
                i = heads[k]
                self.out.append((data[start[i] : end[first_end[i] + d] + 1].tobytes(), int(sums[k])))
            self.open[d], self.edge[d] = (sums[-1], edges[-1]) if still else (0, False)
        self.last = (int(parts[-1]), data[start[-2] :].tobytes())

    def close(self) -> None:
        """Nothing follows: closes what is open."""
        if self.last is None:
            return
        part, key = self.last
        for d, e in enumerate(word_ends(np.frombuffer(key, np.uint8)).tolist()):
            if self.open[d] >= self.least or part >= 0:
                self.out.append((key[: e + 1], int(self.open[d])))
        self.last = None
        self.open[:], self.edge[:] = 0, False


def count_prefixes(rows: DataFrame, codes: Codes, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f) of sorted ``rows`` (key, part, n): whole counts, and partial ones at the ends of hot ranges."""
    sent = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent.value.prepare()
        stack = Stack(least, longest)
        held: list[pa.RecordBatch] = []

        def given() -> pa.RecordBatch:
            table = pa.Table.from_batches(held) if held else None
            if table is not None:
                stack.take(table["key"].combine_chunks(), table["part"].to_numpy(), table["n"].to_numpy())
            held.clear()
            found, stack.out = [(*sent.value.read(key), n) for key, n in stack.out], []
            phrases = pa.array([b" ".join(x[1]) for x in found], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), phrases, pa.array([x[2] for x in found], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _AT_ONCE:
                yield given()
        yield given()
        stack.close()
        yield given()

    return rows.mapInArrow(run, "lang string, phrase string, f long")


def phrase_counts(texts: DataFrame, counts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times.

    ``texts``: (lang, text as binary); ``counts``: their written word counts.
    """
    spark = texts.sparkSession
    frequent = counts.where(F.col("n") >= least)
    most = frequent.orderBy(F.desc("n"), "lang", "word").limit(CODED_WORDS).collect()
    whole = frequent.count() <= CODED_WORDS
    # languages are needed by number only where some words have no code
    langs = [] if whole else sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    codes = Codes([(r["lang"], r["word"].encode()) for r in most], langs, whole)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most as many words as there are tasks; the most frequent words have the short codes
    often = {codes.bytes[k]: r["n"] for k, r in enumerate(most) if len(codes.bytes[k]) < 4 and r["n"] * tasks > total}
    rows = suffix_rows(texts, codes, longest)
    part = F.lit(-1)
    if often:
        hot = {head: 2 * n * tasks // total for head, n in often.items()}
        edges = borders(texts, codes, hot, sum(often.values()), longest)
        ranges = spark.createDataFrame([(bytearray(head), [bytearray(x) for x in found]) for head, found in edges.items()], "head binary, edges array<binary>")
        rows = rows.join(F.broadcast(ranges), F.expr(_HEAD) == F.col("head"), "left")  # as many rows as there are hot words
        part = F.when(F.col("edges").isNotNull(), F.size(F.filter("edges", lambda e: e <= F.col("key")))).otherwise(-1)
    dealt = rows.select("key", part.alias("part"), "n").repartition(tasks, F.expr(_HEAD), "part").sortWithinPartitions(F.desc("key"))
    return count_prefixes(dealt, codes, least, longest).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _n_words(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def cuts(phrases: DataFrame) -> DataFrame:
    """Each candidate of ``phrases`` (lang, phrase, f) with the counts l and r of both parts, one row for each cut after k words."""
    many = phrases.where(_n_words(F.col("phrase")) > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), _n_words(F.col("phrase")) - 1)).alias("k"))
    left = F.expr("substring_index(phrase, ' ', k)")
    many = many.withColumn("left", left).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    side = small_side(phrases)
    for part, name in (("left", "l"), ("right", "r")):
        many = many.join(side.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    return many.select("lang", "phrase", "a", "k", "l", "r")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a longer candidate that holds the phrase's words in a row."""
    words = F.split("phrase", " ")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    return phrases.where(n > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs text and lang; other columns are not read. A null text has no word and a null lang counts
    as ``und``; repeated rows count each. Phrases lie within pieces between the marks .,;:!? and line ends.
    The score is floor(1000 * a * n / (l * r)) at the cut where it is least (the first of equals), with the
    counts a of the phrase, l and r of its parts, and n of all words of the language. Ties of score go by
    a, then by the phrase's bytes. Whole texts are read; an empty table gives no row.
    """
    python_ready(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    words = materialize(word_counts(texts), "words")
    phrases = materialize(phrase_counts(texts, words, least, longest), "phrases")
    sizes = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    exact = "CAST(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0)) AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    scored = cuts(phrases).join(small_side(sizes), "lang").withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = best.join(contained(phrases), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
