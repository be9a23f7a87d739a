import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenloom.llm import dac, packing
from lumenloom.llm.tokens import PieceEncoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, sequence_id string"


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta.\n", "x"], k=9000))
    rows = [(5, "one two three"), (1, None), (2, ""), (2, ""), (9, long), (None, "no id"), (7, "  spaced \n\n\n out\t"), (7, "tie"), (3, long)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 77, "clash") for i, t in rows], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\r\x0b\x1c\u00a0aB.,'7é字-", "ing", "'s", "   "]), max_size=20).map("".join), max_size=6))
def test_pieces_equal_whole_texts(encoder, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_pieces_are_not_kept(encoder):
    text = "a " + "q" * 500 + " b"
    assert encoder.encode([text, None])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert "q" * 500 not in encoder.pieces


def brute_ids(encoder, text, end):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_every_id_is_packed_once(spark, encoder, docs):
    limits = packing.Limits(tokens=64, segments=5, loss_tokens=64)
    got = packing.pack_documents(docs, limits, window=4).collect()
    want = sorted((r.doc_id is None, r.doc_id, brute_ids(encoder, r.text, 0)) for r in docs.collect() if r.doc_id not in (2, 7))
    for key, ids in [(k, i) for _, k, i in want]:
        at = 0
        for p in sorted((r for r in got if r.doc_id == key), key=lambda r: r.start):
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids)
    assert sum(r.length for r in got) == sum(len(brute_ids(encoder, r.text, 0)) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and len(held) <= 5
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_dot_product_takes_the_item_that_uses_scarce_room():
    # loss-bearing tokens are scarce: of two items of equal tokens the one with more of them goes first
    held = packing.fill_sequences(np.array([50, 50, 50]), np.array([5, 20, 1]), packing.Limits(100, 3, 21))
    assert [i for i, _, _ in held[0]] == [1, 2] and [i for i, _, _ in held[1]] == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 40)), max_size=60), st.booleans())
def test_limits_hold_and_nothing_is_lost(items, all_loss):
    tokens = np.array([t for t, _ in items], np.int64)
    loss = tokens if all_loss else np.minimum(np.array([x for _, x in items], np.int64), tokens)
    limits = packing.Limits(100, 4, 100 if all_loss else 40)
    seen = dict.fromkeys(range(len(items)), 0)
    for held in packing.fill_sequences(tokens, loss, limits, 8 if all_loss else 0):
        assert sum(n for _, _, n in held) <= 100 and len(held) <= 4
        if not all_loss:
            assert sum(loss[i] for i, _, _ in held) <= 40
        for i, start, n in held:
            assert start == seen[i]
            seen[i] += n
    assert seen == {i: int(t) for i, t in enumerate(tokens)}


def test_examples_are_not_cut_and_oversize_ones_are_told(spark):
    rows = [("a", 60, 10), ("b", 40, 30), ("c", 101, 1), ("d", 40, 41), ("e", None, None), (None, 30, 5), ("a", 60, 10)]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id string, tokens int, loss_tokens int").coalesce(1), packing.Limits(100, 3, 40)).collect()
    assert len(got) == len(rows)
    assert {r.example_id for r in got if r.sequence_id is None} == {"c", "d", "e"}
    by = {}
    for r in got:
        if r.sequence_id is not None:
            by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        held.sort(key=lambda r: r.segment)
        assert sum(r.tokens for r in held) <= 100 and sum(r.loss_tokens for r in held) <= 40
        assert [r.offset for r in held] == [sum(x.tokens for x in held[:k]) for k in range(len(held))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 65535), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_round_trip_and_random_access(ids, data):
    code = dac.Code(dac.encode_levels(np.array(ids, np.uint32)))
    assert code.slice(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert code[i] == ids[i] and code.slice(i, j).tolist() == ids[i:j]


def test_codes_reach_across_rank_blocks():
    ids = np.random.default_rng(0).integers(0, 50257, 5000)
    code = dac.Code(dac.encode_levels(ids))
    assert [code[i] for i in range(0, 5000, 37)] == ids[::37].tolist()
    with pytest.raises(IndexError):
        code[5000]
    with pytest.raises(ValueError):
        dac.encode_levels(np.array([1 << 20]), (8, 8))


def test_documents_come_back_in_order(spark, encoder, docs):
    segments = dac.write_codes(docs, end_id=2, segment_ids=300)
    got = dac.read_documents(segments).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array(brute_ids(encoder, r.text, 2), "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(9, 0), (9, 4000), (9, 10**6), (5, 2)], "doc_id long, position long")
    found = {(r.doc_id, r.position): r.token for r in dac.tokens_at(segments, asked).collect()}
    nine = brute_ids(encoder, next(r.text for r in rows if r.doc_id == 9), 2)
    assert found == {(9, 0): nine[0], (9, 4000): nine[4000], (9, 10**6): None, (5, 2): brute_ids(encoder, "one two three", 2)[2]}
    assert dac.read_documents(dac.write_codes(docs.limit(0), end_id=2)).count() == 0
