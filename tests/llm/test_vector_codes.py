"""Vector codes against a plain loop over all rows, with odd rows, huge components and clashing columns."""

import hashlib
import math

import numpy as np
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenloom.llm import oracles, queries, vector_codes

SHAPE = "vec_id long, embedding array<double>, label int, x string, row int, key int, weight int, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash", 1, 2, 3, "clash") for i, v, c in rows], SHAPE)


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label, code, error) of each kept row and the digest of the codebooks, in Python integers."""
    kept = [(i, c, [math.floor(1024 * x) for x in v]) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    width = len(first[0][2]) // parts
    cut = lambda v: [v[k * width : (k + 1) * width] for k in range(parts)]
    books = [[cut(r[2])[k] for r in first] for k in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v)[k], books[k])[1], []).append(cut(v)[k])
            books[k] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[k])]
    found = []
    for i, c, v in kept:
        best = [near(cut(v)[k], books[k]) for k in range(parts)]
        found.append((i, c, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    said = ",".join(str(x) for book in books for y in book for x in y)
    return sorted(found, key=repr), hashlib.sha256(said.encode()).hexdigest()


def run(spark, rows, **more):
    coded, books = vector_codes.compress(frame(spark, rows), **more)
    return sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=repr), vector_codes.digest(books)


def test_whole_table(spark, sf_dir):
    assert_same(queries.op13_vector_codes(spark, sf_dir), oracles.OP13, sf_dir)


def test_odd_rows_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 8) / 4).tolist(), i % 3 if i % 5 else None) for i in range(40)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (7, [0.1] * 8, None), (None, [0.5] * 8, 2), (None, [0.5] * 8, 2)]
    rows += [(100, None, 1), (101, [None] + [0.0] * 7, 1), (102, [math.nan] * 8, 1), (103, [math.inf] + [0.0] * 7, 2), (-5, [-0.0001] * 8, 9)]
    for entries in (1, 6, 256):
        assert run(spark, rows, entries=entries) == brute(rows, entries=entries)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e4] * 4, 0), (1, [-3e5, 2.5, 7e5, 1e6], 0), (2, [3e5, -1e6, 0.0, 1e6], 1), (3, [1.5e6, 0, 0, -1e5], 1)]
    assert run(spark, rows, entries=2) == brute(rows, entries=2)
    coded, _ = vector_codes.compress(frame(spark, [(0, [0.0] * 4, 0), (1, [1e300] * 4, 0)]), entries=1, rounds=0)
    assert {r.error for r in coded.collect()} == {0, vector_codes.LARGEST}


def test_empty_tables_and_other_lengths(spark):
    assert run(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, None, 2)])[0] == []
    got, _ = run(spark, [(1, [0.0] * 4, 2), (2, [1.0] * 5, 2), (3, [], 1)])
    assert got == [(1, 2, "00000000", 0), (2, 2, None, None), (3, 1, None, None)]


def test_label_errors_join_null_labels(spark):
    rows = [(i, [i / 7.0, 0, 0, 1], None if i % 2 else 4) for i in range(9)]
    coded, _ = vector_codes.compress(frame(spark, rows), entries=2)
    got = vector_codes.with_label_error(coded).collect()
    for label in (None, 4):
        own = [r for r in got if r.label == label]
        assert {r.label_error for r in own} == {sum(r.error for r in own)}


def test_huge_components_and_null_labels_as_doubles(spark):
    """What two tests above ask of the code, with doubles all through: a column of doubles takes no integers."""
    rows = [(0, [1e4] * 4, 0), (1, [-3e5, 2.5, 7e5, 1e6], 0), (2, [3e5, -1e6, 0.0, 1e6], 1), (3, [1.5e6, 0.0, 0.0, -1e5], 1)]
    assert run(spark, rows, entries=2) == brute(rows, entries=2)
    coded, _ = vector_codes.compress(frame(spark, [(0, [0.0] * 4, 0), (1, [1e300] * 4, 0)]), entries=1, rounds=0)
    assert {r.error for r in coded.collect()} == {0, vector_codes.LARGEST}
    coded, _ = vector_codes.compress(frame(spark, [(i, [i / 7.0, 0.0, 0.0, 1.0], None if i % 2 else 4) for i in range(9)]), entries=2)
    got = vector_codes.with_label_error(coded).collect()
    for label in (None, 4):
        own = [r for r in got if r.label == label]
        assert {r.label_error for r in own} == {sum(r.error for r in own)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(0, 2**40))
def test_nearest_is_exact_at_any_size(points, shift):
    book = np.array(points, np.int64)
    x = book[::-1] + shift % 5 - 2
    index, far = vector_codes.nearest(x, book)
    for row, k, d in zip(x.tolist(), index.tolist(), far.tolist(), strict=True):
        assert (int(d), k) == min((sum((a - b) ** 2 for a, b in zip(row, y, strict=True)), e) for e, y in enumerate(book.tolist()))


@pytest.mark.parametrize("width", [4, 6, 64])
def test_cuts_cover_the_vector(width):
    at = vector_codes.cuts(width)
    assert at[0] == 0 and at[-1] == width and at == sorted(at)
