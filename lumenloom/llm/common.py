"""Plumbing shared by the training-data operators: shared-folder tables, worker paths, words."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.runtime import materialize as materialize

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows in one Arrow batch. A batch of very long documents stays small.
ARROW_ROWS = 256


def python_ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches of long texts small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; of null none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` is called so."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


#: Most rows of fixed width (ids, hashes, counters) that are broadcast; a longer table is joined by shuffle.
BROADCAST_ROWS = 500_000


def small_side(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of fixed-width rows as a join side: broadcast up to ``limit`` rows, else as it is."""
    return F.broadcast(table) if table.count() <= limit else table


#: Rows of one key from which the key counts as hot: a table of N rows has at most N / HOT_ROWS of them.
HOT_ROWS = 100_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (a written one, each key once; ``count``: rows of the key, left out) by ``key``.

    Rows of hot keys stay where they are and meet a broadcast; the others are joined as the planner likes.
    """
    hot = table.where(F.col(count) > HOT_ROWS)
    if hot.isEmpty():
        return rows.join(table.drop(count), key)
    side = small_side(hot.drop(count))
    rest = table.where(F.col(count) <= HOT_ROWS).drop(count)
    return rows.join(side, key).unionByName(rows.join(side, key, "left_anti").join(rest, key))
