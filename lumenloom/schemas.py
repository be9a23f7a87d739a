"""The library's and the ledger's tables: types, keys, required columns, allowed values, and checks of a DataFrame against them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """ddl of the columns; keys that are unique (the first is the primary one); required columns; allowed values; defaults."""

    ddl: str
    keys: tuple[tuple[str, ...], ...]
    required: tuple[str, ...]
    allowed: dict[str, tuple] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


# Columns, constraints and defaults of the stored tables.
TABLES = {
    "papers": Table(
        "paper_id string, doi string, arxiv_id string, pmid string, s2_id string, title string, abstract string, year int, journal string, sources array<string>, pdf_path string, pdf_status string, first_seen timestamp, updated_at timestamp",
        (("paper_id",),), ("paper_id", "sources", "pdf_status", "first_seen", "updated_at"), {"pdf_status": ("none", "open", "fetched", "unavailable")}, {"pdf_status": "none"},
    ),
    "project_papers": Table(
        "project string, paper_id string, triage_label string, triage_score double, triage_model string, status string, acquired_at timestamp, decided_at timestamp",
        (("project", "paper_id"),), ("project", "paper_id", "status", "acquired_at"), {"status": ("screened", "kept", "dropped", "mined")}, {"status": "screened"},
    ),
    "runs": Table(
        "id string, routine string, project string, invocation string, status string, started_at timestamp, finished_at timestamp, input_tokens long, output_tokens long, cached_input_tokens long, cost_cents double, papers_new int, error string",
        (("id",),), ("id", "project", "invocation", "status", "started_at"), {"invocation": ("scheduled", "manual", "backfill"), "status": ("running", "completed", "failed", "aborted_budget", "coalesced")},
        {"status": "running", "input_tokens": 0, "output_tokens": 0, "cached_input_tokens": 0, "cost_cents": 0.0, "papers_new": 0},
    ),
    "cost_events": Table(
        "id long, run_id string, phase string, role string, model string, input_tokens long, output_tokens long, cached_input_tokens long, cost_cents double, cost_source string, occurred_at timestamp",
        (("id",),), ("run_id", "model", "cost_source", "occurred_at"), {"cost_source": ("sdk_reported", "computed")}, {"input_tokens": 0, "output_tokens": 0, "cached_input_tokens": 0, "cost_cents": 0.0, "cost_source": "computed"},
    ),
    "budget_policies": Table(
        "id int, cap_cents long, warn_pct int, hard_stop boolean, window string, updated_at timestamp",
        (("id",),), ("id", "cap_cents", "updated_at"), {"id": (1,)}, {"id": 1, "warn_pct": 80, "hard_stop": True, "window": "calendar_month_utc"},
    ),
    "budget_incidents": Table(
        "id long, threshold string, window_start timestamp, cap_cents long, observed_cents double, status string, opened_at timestamp, resolved_at timestamp",
        (("id",), ("threshold", "window_start")), ("threshold", "window_start", "cap_cents", "observed_cents", "status", "opened_at"),
        {"threshold": ("warning", "hard_stop"), "status": ("open", "acknowledged", "resolved")}, {"status": "open"},
    ),
    "model_pricing": Table(
        "model string, input_cents_per_mtok double, output_cents_per_mtok double, cached_input_cents_per_mtok double, updated_at timestamp",
        (("model",),), ("model", "input_cents_per_mtok", "output_cents_per_mtok", "cached_input_cents_per_mtok", "updated_at"),
    ),
    "source_stats": Table(
        "routine string, source string, seen long, kept long, runs long, muted boolean, skips_since_probe long, updated_at timestamp",
        (("routine", "source"),), ("routine", "source"), {}, {"seen": 0, "kept": 0, "runs": 0, "muted": False, "skips_since_probe": 0},
    ),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """The table without rows."""
    return spark.createDataFrame([], TABLES[name].ddl)


def conform(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the table's columns and types, in its order; absent columns are null, nulls take the table's default."""
    table = TABLES[name]
    have = {c.lower() for c in rows.columns}
    out = []
    for f in empty(rows.sparkSession, name).schema.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.lit(table.defaults[f.name]).cast(f.dataType)) if f.name in table.defaults else c).alias(f.name))
    return rows.select(*out)


def violations(rows: DataFrame, name: str, parent: DataFrame | None = None, reference: str | None = None) -> DataFrame:
    """rule, n: how many rows break each rule that is broken (a key counts its surplus rows).

    ``parent``: a table whose column ``reference`` every row's must be found in.
    """
    table = TABLES[name]
    rules = [(f"{c} is null", F.col(c).isNull()) for c in table.required]
    rules += [(f"{c} is not allowed", F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in table.allowed.items()]
    found = rows.agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.count_if(c).alias("n")) for r, c in rules]).alias("x")).select(F.inline("x"))
    for key in table.keys:
        whole = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        found = found.unionByName(whole.select(F.lit(", ".join(key) + " is not unique").alias("rule"), "n"))
    if parent is not None:
        lost = rows.where(F.col(reference).isNotNull()).join(parent.select(F.col(reference if reference in parent.columns else "id").alias(reference)).distinct(), reference, "left_anti")
        found = found.unionByName(lost.agg(F.lit(f"{reference} is unknown").alias("rule"), F.count(F.lit(1)).alias("n")))
    return found.where("n > 0")
