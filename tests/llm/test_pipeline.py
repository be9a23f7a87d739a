"""Every stage of the pipeline against brute force on its own input, then the run as a whole."""

import collections
import zlib

import numpy as np
import pytest
from test_near_copies import brute as brute_copies
from test_text_operators import CLASHES, WORD, brute_spread, brute_targets
from pyspark.sql import functions as F

import corpus_pipeline
from lumenloom.llm import queries
from lumenloom.llm.common import materialize
from lumenloom.llm.tokens import PieceEncoder, default_vocabulary


@pytest.fixture(scope="module")
def fixture(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    line = "this very line stands on many sites"
    text = docs.where("lang = 'en'").orderBy("doc_id").first().text
    rows = [(5000 + k, f"{line}\n{text[: 300 + 40 * k]}", "en", f"src{k}", 9) for k in range(7)]
    rows += [(6000, text, "en", "src1", 9), (6001, text, None, None, 9), (6002, None, "en", "src1", None), (6003, "12 %% 34", "en", "src1", 8), (6004, "", "de", "src1", 0), (6005, line, "en", "src9", 35), (None, text[50:500], "en", "src2", 9), (6000, text, "en", "src1", 9)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(3)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, fixture, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "source_mix", "packing"]

    kept = materialize(stages["language_id"](spark, fixture, sf_dir), "t1")
    assert kept.columns == fixture.columns
    assert sorted(rows_of(kept), key=repr) == sorted((r for r in rows_of(fixture) if r[1] and any(c.isalpha() for c in r[1])), key=repr)

    cut = materialize(stages["line_dedup"](spark, kept, sf_dir), "t2")
    want = collections.Counter((i, t) for i, t, _, gone in brute_spread([(r[0], r[1], r[3]) for r in rows_of(kept)]) if not gone or WORD.search(t))
    assert cut.columns == fixture.columns and collections.Counter((r[0], r[1]) for r in rows_of(cut)) == want
    changed = {r[0]: r for r in rows_of(cut)}
    assert changed[5006][4] == len(changed[5006][1]) and "stands on many sites" not in changed[5006][1] and 6005 not in changed

    apart = materialize(stages["near_dedup"](spark, cut, sf_dir), "t3")
    before = [r for r in rows_of(cut) if r[0] is not None]
    # rows of one doc_id are told apart by their text
    known = sorted({(r[0], r[1]) for r in before}, key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    component = dict(brute_copies([(i, t) for i, (_, t) in enumerate(known)]))
    want = sorted([known[i][0] for i in set(component.values())] + [None] * sum(r[0] is None for r in rows_of(cut)), key=repr)
    assert sorted((r[0] for r in rows_of(apart)), key=repr) == want

    mixed = materialize(stages["source_mix"](spark, apart, sf_dir), "t4")
    before, after = rows_of(apart), collections.Counter(rows_of(mixed))
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r[3]] += size(r)
    assert set(after) <= set(before) and max(after.values()) <= 3
    for r, n in after.items():
        taken[r[3]] += n * size(r)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= max(size(r) for r in before if r[3] == source)

    pieces = stages["packing"](spark, mixed, sf_dir).collect()
    encoder = PieceEncoder(default_vocabulary())
    ids = {r[0]: np.array([*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in before}
    assert sum(p.length for p in pieces) == sum(n * len(ids[r[0]]) for r, n in after.items())
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)
    held = collections.Counter()
    for p in pieces:
        held[p.sequence_id] += p.length
    assert max(held.values()) <= 1024


def test_stages_take_empty_tables_and_other_columns(spark, fixture, sf_dir):
    docs = fixture.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    other = [F.lit(k).alias(c) for k, c in enumerate(CLASHES)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, fixture.select("*", *other), sf_dir)
        assert got.columns == [*fixture.columns, *CLASHES], name
        assert sorted(map(repr, rows_of(got))) == sorted(map(repr, rows_of(stage(spark, fixture, sf_dir)))), name
    assert corpus_pipeline.packing_stage(spark, fixture.select("*", *other), sf_dir).count() > 0


def test_columns_that_a_stage_makes_are_the_callers_where_it_has_them(spark, fixture, sf_dir):
    """Extra columns of exactly the names that operators give their results keep type and value through every stage."""
    made = "size source_size target copies taken __copy copy n_lines n_removed own_size own_n_lines".split()
    docs = fixture.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in made])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.schema == docs.schema, name
        wrong = [F.col(f"`{c}`") != F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in made]
        assert got.where(F.exists(F.array(*wrong), lambda x: x)).count() == 0 and got.count() > 100, name


def test_language_stage_keeps_languages_and_rejects_noise(spark, fixture, sf_dir):
    noise = [(7000, "xq7 zzkw qqj " * 40, "en", "s", 9), (7001, "\U000f0000 1 2", "en", "s", 9)]
    got = corpus_pipeline.language_id(spark, fixture.unionByName(spark.createDataFrame(noise, fixture.schema)), sf_dir)
    assert got.where("doc_id >= 7000").count() == 0
    assert got.where("doc_id < 5000").count() == fixture.where("doc_id < 5000").count()


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
