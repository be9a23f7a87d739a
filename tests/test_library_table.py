"""Batches that come to the library one after the other against one whole fold."""

import random

import pytest

from lumenloom.operators import resolve
from lumenloom.operators.library_table import LibraryTable

SHAPE = "seq long, doi string, arxiv_id string, pmid string, s2_id string, title string, abstract string, year int, journal string, source string"


def records(seed, n, ids):
    rng = random.Random(seed)
    some = lambda kind: rng.choice([None, None, "", f"{kind}{rng.randrange(ids)}"])
    return [(k, some("10.1/"), some("2401."), some("p"), some("s"), rng.choice([None, f"t{k}"]), None, rng.choice([None, 2000 + k % 9]), None, rng.choice("abc")) for k in range(n)]


def rows(df):
    return sorted(((r.paper_id, r.doi, r.arxiv_id, r.pmid, r.s2_id, r.title, r.year, tuple(r.sources), r.first_seq) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "batches"), [(1, 2), (2, 4)])
def test_batches_give_the_rows_of_one_fold(spark, tmp_path, seed, batches):
    every = records(seed, 60, 12)
    library = LibraryTable(spark, str(tmp_path / "library"), 8)
    size = -(-len(every) // batches)
    for k in range(batches):
        library.merge(spark.createDataFrame(every[k * size : (k + 1) * size], SHAPE), k)
        want = resolve.merge_papers(spark.createDataFrame(every[: (k + 1) * size], SHAPE))
        assert rows(library.papers()) == rows(want), k


def test_only_touched_papers_are_read(spark, tmp_path):
    library = LibraryTable(spark, str(tmp_path / "library"), 16)
    library.merge(spark.createDataFrame([(k, f"10.1/{k}", None, None, None, f"t{k}", None, None, None, "a") for k in range(200)], SHAPE), 0)
    new = spark.createDataFrame([(300, "10.1/5", None, "p5", None, None, None, 1999, None, "b"), (301, "10.1/new", None, None, None, "n", None, None, None, "b"), (302, None, None, None, None, "no id", None, None, None, "b")], SHAPE)
    ids = spark.createDataFrame([("doi", "10.1/5")], "kind string, value string")
    assert "PartitionFilters: [isnotnull(bucket" in library.touched(ids)._jdf.queryExecution().toString() or "bucket#" in library.touched(ids)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1][:80]
    assert library.merge(new, 1) == {"read": 1, "written": 2, "gone": 0}
    assert library.papers().count() == 201
    assert library.papers().where("paper_id = 'doi:10.1/5'").first().pmid == "p5"
    assert library.merge(new, 1) == {"read": 0, "written": 0, "gone": 0}  # the same batch again


def test_a_bridge_joins_papers_and_frees_an_identifier(spark, tmp_path):
    library = LibraryTable(spark, str(tmp_path / "library"), 4)
    one = lambda seq, doi, pmid: spark.createDataFrame([(seq, doi, None, pmid, None, None, None, None, None, "a")], SHAPE)
    library.merge(one(1, "10.1/a", "1"), 0)
    library.merge(one(2, None, "2"), 1)
    assert library.merge(one(3, "10.1/a", "2"), 2) == {"read": 2, "written": 1, "gone": 1}
    library.merge(one(4, None, "2"), 3)  # lost in the merge: it starts a paper again
    every = [(1, "10.1/a", None, "1", None, None, None, None, None, "a"), (2, None, None, "2", None, None, None, None, None, "a"), (3, "10.1/a", None, "2", None, None, None, None, None, "a"), (4, None, None, "2", None, None, None, None, None, "a")]
    want = rows(resolve.merge_papers(spark.createDataFrame(every, SHAPE)))
    assert rows(library.papers()) == want and {r[0] for r in want} == {"doi:10.1/a", "pmid:2"}
    library.compact(4)
    assert library.versions() == [4] and rows(library.papers()) == want
    library.merge(one(5, "10.1/b", "2"), 5)
    assert rows(library.papers()) == rows(resolve.merge_papers(spark.createDataFrame([*every, (5, "10.1/b", None, "2", None, None, None, None, None, "a")], SHAPE)))


def test_a_version_that_was_written_in_part_does_not_count(spark, tmp_path):
    library = LibraryTable(spark, str(tmp_path / "library"), 4)
    first = spark.createDataFrame([(1, "10.1/a", None, None, None, "t", None, None, None, "a")], SHAPE)
    library.merge(first, 0)
    stray = library.papers().withColumns({"gone": resolve.F.lit(True), "bucket": resolve.F.lit(0)})
    stray.write.partitionBy("bucket").parquet(library._path("papers", 1))
    assert library.papers().count() == 1
    library.merge(spark.createDataFrame([(2, "10.1/b", None, None, None, "u", None, None, None, "a")], SHAPE), 1)
    assert library.papers().count() == 2
    assert library.merge(first.limit(0), 2) == {"read": 0, "written": 0, "gone": 0}


def test_a_component_costs_its_rows_and_not_a_call(spark, tmp_path):
    """Components go through a task in one pass: neither a plan of the fold nor one of a batch has a group of pandas rows a component."""
    frame = spark.createDataFrame([(k, f"10.1/{k // 2}", None, None, None, f"t{k}", None, None, None, "a") for k in range(5000)], SHAPE)
    found = resolve.merge_papers(frame)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2500  # more than a batch that is given back
    assert {r.title for r in found.collect()} == {f"t{k}" for k in range(0, 5000, 2)}
