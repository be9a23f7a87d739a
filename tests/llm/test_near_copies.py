"""Near copies by shingle similarity against brute force over all pairs."""

import random

import pytest
from test_text_operators import WORD, frame

import corpus_pipeline
from lumenloom.llm import near_copies, simhash


def brute(rows, shingle=5, least=0.8):
    """doc_id -> least doc_id reachable."""
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted((doc, low[find(i)]) for i, (doc, _) in enumerate(rows))


def edited():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, doc = [], 0
    for n in (6, 40, 120, 700):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for edits in (0, 0, 1, 2, 3, 6, 20):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = word()
                rows.append((doc, " ".join(copy)))
                doc += 1
    chain = [word() for _ in range(130)]
    rows += [(doc + k, " ".join(chain[k * 5 : k * 5 + 70])) for k in range(8)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "two words"), (5004, "Two  WORDS"), (5005, rows[8][1]), (5005, rows[50][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [3, near_copies.CHUNK])
def test_components_equal_brute_force(spark, chunk):
    rows = edited()
    df = frame(spark, [(i, t, "s") for i, t in rows])
    got = sorted((r.doc_id, r.component_id) for r in near_copies.components(df, chunk=chunk).collect())
    assert got == brute(rows)
    assert near_copies.components(df.limit(0)).count() == 0


def test_stage_removes_copies_that_two_bits_do_not_reach(spark, sf_dir):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
    copy = [*base[:30], "edited", *base[31:60], "again", *base[61:]]
    texts = [" ".join(base), " ".join(copy), " ".join(reversed(base))]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 2
    df = frame(spark, [(1, texts[0], "s"), (2, texts[1], "s"), (3, texts[2], "s"), (None, texts[1], "s")])
    stay = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert stay.columns == df.columns
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == [1, 3, None]


def test_radius_grows_as_similarity_falls():
    assert near_copies.radius(1.0) == 0 < near_copies.radius(0.9) < near_copies.radius(0.8) <= 26
