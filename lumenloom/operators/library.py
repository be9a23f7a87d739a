"""The paper library and its project links: look-ups, links, triage and PDF state, merges, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.runtime import small_side

#: Identifier columns, strongest first.
IDS = ("doi", "arxiv_id", "pmid", "s2_id")


def _identifiers(rows: DataFrame, key: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strength"), F.col(c).alias("value")) for k, c in enumerate(IDS)]))
    return rows.select(key, each.alias("x")).where("x.value IS NOT NULL AND x.value <> ''").select(key, "x.strength", "x.value")


def lookup(papers: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, paper_id, strength (0: by doi, 3: by s2_id) of every paper that shares an identifier with a wanted row."""
    mine = _identifiers(wanted, key)
    theirs = _identifiers(papers, "paper_id")
    return mine.join(theirs, ["strength", "value"]).groupBy(key, "paper_id").agg(F.min("strength").alias("strength"))


def relink(links: DataFrame, merged: DataFrame) -> DataFrame:
    """Links after merges (``merged``: paper_id, survivor, place of the loser): the survivor's own decision stays, then the first loser's."""
    side = small_side(merged.select(F.col("paper_id").alias("__loser"), F.col("survivor").alias("__survivor"), F.col("place").alias("__place")))
    moved = links.join(side, F.col("paper_id") == F.col("__loser"), "left")
    rest = [c for c in links.columns if c not in ("project", "paper_id")]
    order = F.struct(F.coalesce("__place", F.lit(-1)), "paper_id")
    kept = moved.groupBy("project", F.coalesce("__survivor", "paper_id").alias("__paper")).agg(F.min_by(F.struct(*rest), order).alias("x"))
    return kept.select("project", F.col("__paper").alias("paper_id"), "x.*").select(*links.columns)


def without(papers: DataFrame, merged: DataFrame) -> DataFrame:
    """Papers that no merge has removed."""
    return papers.join(small_side(merged.select("paper_id").distinct()), "paper_id", "left_anti").select(*papers.columns)


def link(links: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Links to append: each new (project, paper_id) once, screened, if it is not there yet."""
    fresh = new.select("project", "paper_id").distinct().join(links.select("project", "paper_id"), ["project", "paper_id"], "left_anti")
    return fresh.select("project", "paper_id", F.lit("screened").alias("status"), now.alias("acquired_at"))


def seen(links: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The asked rows that are there."""
    return asked.join(links.select(*keys).distinct(), keys, "left_semi")


def untriaged(links: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Links without a decision."""
    return links.join(decided.select(*keys).distinct(), keys, "left_anti")


def set_triage(links: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Links with the decisions (project, paper_id, label, score, model, status): a null status leaves the old one."""
    made = decisions.select("project", "paper_id", F.struct("label", "score", "model", "status").alias("__d"))
    joined = links.join(made, ["project", "paper_id"], "left")
    hit = F.col("__d").isNotNull()
    new = {
        "triage_label": F.when(hit, F.col("__d.label")).otherwise(F.col("triage_label")), "triage_score": F.when(hit, F.col("__d.score")).otherwise(F.col("triage_score")),
        "triage_model": F.when(hit, F.col("__d.model")).otherwise(F.col("triage_model")), "status": F.coalesce("__d.status", "status"), "decided_at": F.when(hit, now).otherwise(F.col("decided_at")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in links.columns])


def set_pdf(papers: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Papers with the PDF state of ``files`` (paper_id, path, status; null status: fetched)."""
    made = files.select("paper_id", F.struct("path", F.coalesce("status", F.lit("fetched")).alias("status")).alias("__f"))
    joined = papers.join(made, "paper_id", "left")
    hit = F.col("__f").isNotNull()
    new = {"pdf_path": F.when(hit, F.col("__f.path")).otherwise(F.col("pdf_path")), "pdf_status": F.when(hit, F.col("__f.status")).otherwise(F.col("pdf_status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in papers.columns])


def of_project(links: DataFrame, papers: DataFrame, project: str | None = None, status: str | None = None) -> DataFrame:
    """Papers of a project (of all without one) with triage_label, triage_score and proj_status; only those of ``status`` if given."""
    rows = links if project is None else links.where(F.col("project") == project)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.select("project", "paper_id", "triage_label", "triage_score", F.col("status").alias("proj_status")).join(papers, "paper_id")


def pdf_pending(links: DataFrame, papers: DataFrame, project: str | None = None) -> DataFrame:
    """Kept papers whose PDF was not fetched yet."""
    return of_project(links, papers, project, "kept").where(F.col("pdf_status").isin("none", "unavailable"))


def counts(papers: DataFrame, links: DataFrame) -> DataFrame:
    """One row: papers, project_links."""
    return papers.agg(F.count(F.lit(1)).alias("papers")).crossJoin(links.agg(F.count(F.lit(1)).alias("project_links")))


def new_since(links: DataFrame, papers: DataFrame, project: str | None, since: Column, most: int = 25) -> DataFrame:
    """The best ``most`` kept papers acquired after ``since``, by score, with place: what a digest shows."""
    kept = of_project(links.where(F.col("acquired_at") > since), papers, project, "kept")
    top = kept.orderBy(F.desc_nulls_last("triage_score"), "paper_id").limit(most)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("triage_score"), "paper_id")).cast("long"))
