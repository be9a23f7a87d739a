"""Shared-folder tables: how lineage is cut so that a lost executor loses nothing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local master without one gets one, a cluster must name its own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back; ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are deleted when the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def workers_ready(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def sweep(spark: SparkSession) -> None:
    """Delete this application's tables from the shared folder, when no DataFrame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lumenloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows of fixed width (ids, hashes, counters) that are broadcast; a longer table is joined by shuffle.
BROADCAST_ROWS = 500_000


def small_side(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written or cheap table of narrow rows as a join side: broadcast up to ``limit`` rows, else as it is."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
