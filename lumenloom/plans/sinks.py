"""Writers and small rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text


def flat(df: DataFrame) -> DataFrame:
    """Columns as CSV cells: lists joined by ``; ``, doubles with three digits, structs and maps as JSON."""
    cell = {
        "array<string>": lambda c: F.array_join(c, "; "),
        "double": lambda c: F.format_string("%.3f", c),
        "float": lambda c: F.format_string("%.3f", c),
    }
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in cell:
            out.append(F.when(c.isNotNull(), cell[kind](c)).alias(name))
        elif kind.startswith(("struct", "map", "array")):
            out.append(F.to_json(c).alias(name))
        else:
            out.append(c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows of new keys to a Parquet table and return them: a resumable cache or result grid."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = df.select(*keys).limit(0)
    new = df.join(known.distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """The first ``rows`` rows, for a report."""
    shown = flat(df).limit(rows).collect()
    clean = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(clean(x) for x in r) + " |" for r in shown])


def digest(project: str, new: DataFrame, spent: DataFrame, stats: DataFrame) -> str:
    """Markdown digest: new kept papers by score (25 at most), month-to-date cost, source statistics."""
    top = new.orderBy(F.desc_nulls_last("score"), "paper_id").select("paper_id", "title", "score")
    cost = spent.select(text.money(F.coalesce(F.col("observed"), F.lit(0)).cast("double")).alias("m")).first()["m"]
    return "\n\n".join([f"# Digest: {project}", f"## New papers ({new.count()})", markdown_table(top, 25), f"Month to date: {cost}", "## Sources", markdown_table(stats.orderBy("source"))])
