"""The library as a table of versions: a batch of records reads and writes only the papers that its identifiers reach.

``folder``/papers and ``folder``/ids are cut into buckets by hash, of the paper's id and of the identifier. A
batch looks its identifiers up in the buckets they fall into, reads the papers they lead to, replays the new
records on those, component by component, and writes what changed as a version of its own: papers, papers
that are gone, and where identifiers lead now. The latest row of a key counts. A version is there once it is
in the log; one that was written in part is written over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import resolve
from lumenloom.operators.resolve import IDS, PAPER
from lumenloom.runtime import materialize

#: Buckets of both tables. A table keeps the number it began with.
BUCKETS = 64


class LibraryTable:
    """Papers under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, table: str, version: int) -> str:
        return f"{self.folder}/{table}/version={version}"

    def versions(self) -> list[int]:
        """Versions that count: the last whole one, and those after it."""
        try:
            log = self.spark.read.parquet(f"{self.folder}/log").select("version", "whole").collect()  # one row a version
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return []
            raise
        first = max((r["version"] for r in log if r["whole"]), default=-1)
        return sorted(r["version"] for r in log if r["version"] >= first)

    def _rows(self, table: str, schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows of the versions that count, of some buckets: the others are not read."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], f"{schema}, version int, bucket int")
        held = self.spark.read.schema(f"{schema}, version int, bucket int").option("basePath", f"{self.folder}/{table}").parquet(*[self._path(table, v) for v in versions])
        return held if buckets is None else held.where(F.col("bucket").isin([int(b) for b in buckets]))

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def papers(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The papers as they are now."""
        rows = self._rows("papers", f"{PAPER}, gone boolean", buckets)
        columns = [c.split()[0] for c in PAPER.split(", ")]
        last = rows.groupBy("paper_id").agg(F.max_by(F.struct("gone", *[c for c in columns if c != "paper_id"]), "version").alias("x"))
        return last.where("NOT x.gone").select("paper_id", "x.*").select(*columns)

    def find(self, ids: DataFrame) -> DataFrame:
        """(kind, value, paper_id) of those identifiers ``ids`` (kind, value) that lead to a paper."""
        wanted = materialize(ids.distinct().withColumn("bucket", self._bucket("value")), "wanted-ids")
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # one row a bucket at most
        rows = self._rows("ids", "kind string, value string, paper_id string", buckets)
        held = rows.join(wanted.select("kind", "value"), ["kind", "value"], "left_semi")
        return held.groupBy("kind", "value").agg(F.max_by("paper_id", "version").alias("paper_id")).where("paper_id IS NOT NULL")

    def touched(self, ids: DataFrame) -> DataFrame:
        """The papers that identifiers lead to, read from their buckets alone."""
        names = materialize(self.find(ids).select("paper_id").distinct().withColumn("bucket", self._bucket("paper_id")), "touched")
        buckets = [r["bucket"] for r in names.select("bucket").distinct().collect()]
        return self.papers(buckets).join(names.select("paper_id"), "paper_id", "left_semi")

    def merge(self, records: DataFrame, version: int) -> dict[str, int]:
        """Bring a batch of ``records`` (as for ``resolve.merge_papers``) to the library as ``version``.

        Batches come in the order of ``seq``. A version that is in the log already is left as it is, so that a
        batch which runs again changes nothing. Returns how many papers were read, are written and are gone.
        """
        if version in self.versions():
            return {"read": 0, "written": 0, "gone": 0}
        new = materialize(resolve.with_ids(records), "new-records")
        held = materialize(self.touched(_ids(new)), "touched-papers")
        # papers and records in one graph: a paper stands before all records
        graph = new.select(F.concat(F.lit("1:"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("row"), *[c for c, _ in IDS]).unionByName(held.select(F.concat(F.lit("0:"), "paper_id").alias("row"), *[c for c, _ in IDS]))
        parts = materialize(resolve.components(graph, "row", [c for c, _ in IDS]), "touched-components")
        old = held.withColumn("row", F.concat(F.lit("0:"), "paper_id")).join(parts, "row").drop("row")
        fresh = new.withColumn("row", F.concat(F.lit("1:"), F.lpad(F.col("seq").cast("string"), 20, "0"))).join(parts, "row").drop("row")
        after = materialize(resolve.replayed(fresh, old), "papers-after")
        gone = held.join(after, "paper_id", "left_anti")
        changed = after.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
        leads = _ids(after, "paper_id")
        lost = _ids(held).join(leads, ["kind", "value"], "left_anti").distinct().withColumn("paper_id", F.lit(None).cast("string"))
        counts = {"read": held.count(), "written": after.count(), "gone": gone.count()}
        self._write(version, changed, leads.unionByName(lost), counts, False)
        return counts

    def compact(self, version: int) -> None:
        """Write all papers as one whole version, from which on versions count."""
        if version in self.versions():
            return
        now = materialize(self.papers(), "papers-now")
        self._write(version, now.withColumn("gone", F.lit(False)), _ids(now, "paper_id"), {"read": 0, "written": now.count(), "gone": 0}, True)

    def _write(self, version: int, papers: DataFrame, ids: DataFrame, counts: dict[str, int], whole: bool) -> None:
        for table, rows, key in (("papers", papers, "paper_id"), ("ids", ids, "value")):
            rows.withColumn("bucket", self._bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(table, version))
        log = self.spark.createDataFrame([(version, whole, *counts.values())], f"version int, whole boolean, {', '.join(f'{k} long' for k in counts)}")
        log.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")


def _ids(rows: DataFrame, *more: str) -> DataFrame:
    """(kind, value, more) of the identifiers that rows have."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c, _ in IDS]))
    return rows.select(each.alias("x"), *more).where("x.value IS NOT NULL").select("x.kind", "x.value", *more)
