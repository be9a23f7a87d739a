"""The second half of a 128-bit hash is not a function of the first."""

import xxhash
from pyspark.sql import functions as F
from test_text_operators import frame

from lumenloom.llm import digests, line_spread


def test_halves_are_independent(spark):
    line = "one line of several words"
    df = frame(spark, [(1, line, "s")])
    salt = xxhash.xxh64_intdigest(b"wide", 42)
    one, two = xxhash.xxh64_intdigest(line.encode(), 42), xxhash.xxh64_intdigest(line.encode(), salt)
    assert df.select(digests.bucket(F.col("text"))).first()[0] == f"{one:016x}{two:016x}"
    found = line_spread._lines(df.withColumn("site", F.lit("s")), 4).first()
    assert (found.h1 % (1 << 64), found.h2 % (1 << 64)) == (one, two)
