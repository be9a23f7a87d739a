"""Queries of acquisition and calls whose whole results have no SQL, against the plain ways."""

from lumenloom import catalogue


def rows(df):
    return sorted((tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_a_library_in_batches_is_the_whole_fold(spark, sf_dir):
    found = catalogue.queries()
    assert rows(found["library_in_batches"](spark, sf_dir)) == rows(found["paper_merge"](spark, sf_dir))
