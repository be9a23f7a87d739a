"""Phrase collocations against brute force: hot words over ranges, odd texts, ties, clashing columns."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.llm import oracles, phrases, queries

SHAPE = "lang string, text string, head string, part int, suffix string, n long, phrase string, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, "clash", 1, "clash", 2, "clash", "clash", 3) for lang, text in rows], SHAPE)


def brute_counts(rows, longest=5):
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    return counts, sizes


def brute(rows, least, longest=5, top=2000, absorbed=100):
    counts, sizes = brute_counts(rows, longest)
    often = {k: f for k, f in counts.items() if f >= least}
    found = collections.defaultdict(list)
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        within = [f for (lg, ws), f in often.items() if lg == lang and len(ws) > len(words) and any(ws[i : i + len(words)] == words for i in range(len(ws)))]
        if any(100 * f >= absorbed * a for f in within):
            continue
        n = sizes[lang]
        score, _, left, right = min((1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
        found[lang].append((-score, -a, " ".join(words).encode(), left, right, n))
    return sorted((lang, rank, p.decode(), -a, left, right, n, -s) for lang, got in found.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(got)[:top], 1))


def run(docs, **more):
    return sorted(tuple(r) for r in phrases.collocations(docs, **more).collect())


def texts(docs):
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "a", "\x01", "é", "the\x1f", "zz", "x-y", "日本"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", "\t", "  ", ". ", "\n", " the ", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, " \t\n"), ("fr", "the of a " * 3000)] + [("en", "one two three four five six")] * 9
    return rows


def test_whole_table(spark, sf_dir):
    assert_same(queries.op12_suffix_sigma(spark, sf_dir), oracles.OP12, sf_dir)


@pytest.mark.parametrize(("least", "longest", "top", "absorbed"), [(3, 5, 2000, 100), (2, 4, 7, 60), (9, 2, 3, 100)])
def test_brute_force(spark, odd, least, longest, top, absorbed):
    got = run(frame(spark, odd), least=least, longest=longest, top=top, absorbed=absorbed)
    assert got == brute(odd, least, longest, top, absorbed)


def test_more_words_than_have_codes(spark, odd, monkeypatch):
    monkeypatch.setattr(phrases, "CODED_WORDS", 2)
    assert run(frame(spark, odd), least=3) == brute(odd, 3)


def test_hot_words_over_many_ranges(spark, odd):
    docs = texts(frame(spark, odd))
    counts = phrases.materialize(phrases.word_counts(docs), "words")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = phrases.phrase_counts(docs, counts, least=4)
        want, _ = brute_counts(odd)
        assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == {k: f for k, f in want.items() if f >= 4}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_empty_table(spark, odd):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [("en", None)])) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "ab", "b", "\x01", "ü", "zz"]), min_size=1, max_size=4), st.integers(1, 5)), max_size=40), st.integers(1, 6), st.integers(1, 7), st.integers(0, 3), st.booleans())
def test_stack_counts_prefixes_in_any_slices(rows, least, step, ranges, whole):
    """Keys of one task, cut into slices and into ranges, give whole counts once added up."""
    coded = ["a", "ab", "b", "\x01", "ü", "zz"] if whole else ["ab", "ü"]
    codes = phrases.Codes([("en", w.encode()) for w in coded], ["de", "en"], whole)
    codes.prepare()
    token = lambda w: codes.bytes[coded.index(w)] if w in coded else w.encode() + b"\t1 "
    want = collections.Counter()
    for words, n in rows:
        for m in range(1, len(words) + 1):
            want["en", tuple(words[:m])] += n
    filled = lambda x: x + b"\x80" * (-len(x) % 16)
    keys = sorted(((filled(b"".join(map(token, words))), n) for words, n in rows), reverse=True)
    border = sorted({x for x, _ in keys})[:ranges]
    found = collections.Counter()
    stack = phrases.Stack(least, 4)
    for i in range(0, len(keys), step):
        part = keys[i : i + step]
        # ranges are numbered for each first word by itself
        parts = np.array([sum(e <= x and e[:2] == x[:2] for e in border) if ranges else -1 for x, _ in part])
        stack.take(pa.array([x for x, _ in part], pa.binary()), parts, np.array([n for _, n in part]))
    stack.close()
    for key, f in stack.out:
        lang, words = codes.read(key)
        found[lang, tuple(w.decode() for w in words)] += f
    assert {k: f for k, f in found.items() if f >= least} == {k: f for k, f in want.items() if f >= least}


def test_codes_are_in_no_text_and_end_by_themselves():
    many = [phrases.code(k) for k in [*range(3000), *range(53_000, 54_000), 6_000_000]]
    assert len(set(many)) == len(many) and {len(x) for x in many} == {2, 3, 4}
    assert not any(a != b and b.startswith(a) for a in many[:900] for b in many)
    for x in many:
        with pytest.raises(UnicodeDecodeError):
            x[:1].decode()
        assert phrases.word_ends(np.frombuffer(x + "é ".encode() + x, np.uint8)).tolist() == [len(x) - 1, len(x) + 2, 2 * len(x) + 2]


@pytest.mark.parametrize("whole", [True, False])
def test_suffixes_of_a_batch(whole):
    codes = phrases.Codes([("en", b"a"), ("en", b"b"), ("fr", b"a")], ["en", "fr"], whole)
    codes.prepare()
    keys, times = phrases.coded_suffixes(["en", "fr", "en", "en"], [b"A b x a. b", b"a", None, b"b"], codes, 2)
    got = collections.Counter()
    assert {len(x) % 16 for x in keys.to_pylist()} == {0}
    for key, n in zip(keys.to_pylist(), times.tolist(), strict=True):
        lang, words = codes.read(key)
        got[lang, b" ".join(words)] += n
    want = {("en", b"a b"): 1, ("en", b"b"): 3, ("en", b"a"): 1, ("fr", b"a"): 1} if whole else {("en", b"a b"): 1, ("en", b"b x"): 1, ("en", b"x a"): 1, ("en", b"a"): 1, ("en", b"b"): 2, ("fr", b"a"): 1}
    assert got == want
