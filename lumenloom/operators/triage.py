"""Triage of untriaged papers by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text

Model = Callable[[str], str]


def prompt(focus: str, title: Column, abstract: Column) -> Column:
    said = "Decide whether this paper is worth deep reading for the focus above. Answer in one line: RELEVANT, BORDERLINE or NOT_RELEVANT, then a score from 0.0 to 1.0."
    return F.concat(F.lit(f"PROJECT FOCUS:\n{focus}\n\n{said}\n\nTITLE: "), F.coalesce(title, F.lit("")), F.lit("\nABSTRACT: "), F.coalesce(abstract, F.lit("")))


def triage(papers: DataFrame, focus: str, model: Model, keep: float = 0.5) -> DataFrame:
    """Papers (title, abstract, triage_label) with label, score and status for those without a label.

    A blank abstract is BORDERLINE 0.3 and dropped without a model call.
    """

    @F.pandas_udf("string")
    def answer(asked: pd.Series) -> pd.Series:
        return asked.map(lambda x: None if x is None else model(x))

    blank = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    todo = papers.where(F.col("triage_label").isNull())
    asked = todo.withColumn("__answer", answer(F.when(~blank, prompt(focus, F.col("title"), F.col("abstract")))))
    label = F.when(blank, "BORDERLINE").otherwise(text.parse_label(F.col("__answer")))
    scored = asked.withColumn("label", label).withColumn("score", F.when(blank, 0.3).otherwise(text.parse_score(F.col("__answer"), F.col("label"))))
    status = F.when(~blank & (F.col("score") >= keep), "kept").otherwise("dropped")
    return scored.withColumn("status", status).drop("__answer")
