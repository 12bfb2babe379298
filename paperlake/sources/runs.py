"""Run tables: one row per saved search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import strip

# Defaults of a run.
DEFAULT_MAX_PAPERS = 150
DEFAULT_THRESHOLD = 0.92


def run_table(
    df: DataFrame,
    run_id: str | Column,
    prompt: str | Column,
    fields: str | Column,
    max_papers: Column | None = None,
    dedup_threshold: Column | None = None,
    no_preprint: Column | None = None,
) -> DataFrame:
    """Runs from any table; ``fields`` is a comma-separated list or an array.

    Repeated fields are listed once.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    shaped = df.select(
        col(run_id).cast("bigint").alias("run_id"), col(prompt).alias("prompt"),
        col(fields).alias("fields"),
        F.coalesce(*[c for c in (max_papers, F.lit(DEFAULT_MAX_PAPERS)) if c is not None])
        .cast("int").alias("max_papers"),
        F.coalesce(*[c for c in (dedup_threshold, F.lit(DEFAULT_THRESHOLD)) if c is not None])
        .cast("double").alias("dedup_threshold"),
        F.coalesce(*[c for c in (no_preprint, F.lit(False)) if c is not None]).alias("no_preprint"),
    )
    if dict(shaped.dtypes)["fields"] == "string":
        shaped = shaped.withColumn("fields", F.split("fields", ","))
    return shaped.withColumn("fields", F.array_distinct(F.transform("fields", strip)))
