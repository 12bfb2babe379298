"""Coverage scores, attempt selection and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.records import field_names, is_filled, truthy, with_key_names
from paperlake.operators.ranking import prefix_cap

# Borders (all strict) and factors of the score, and the most attempts after the first.
LOW_COVERAGE, COVERAGE_FACTOR = 0.3, 0.5
LOW_PRIMARY, PRIMARY_FACTOR = 0.4, 0.7
ACCEPTED_SCORE = 0.5
MAX_RETRIES = 2


def record_tallies(records: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: records, requested cells, filled cells and records with the first field."""
    asked = runs.select("run_id", field_names(F.col("fields")).alias("_names"))
    record = with_key_names(F.col("fields"))
    cells = (
        records.select(*keys, record.alias("_record"))
        .join(asked, "run_id")
        .select(
            *keys,
            F.size(F.filter("_names", lambda f: is_filled(F.col("_record")[f]))).alias("_filled"),
            F.size("_names").alias("_cells"),
            truthy(F.col("_record")[F.col("_names")[0]]).cast("int").alias("_hit"),
        )
    )
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n_records"), F.sum("_cells").alias("n_cells"),
        F.sum("_filled").alias("n_filled"), F.sum("_hit").alias("primary_hits"),
    )


def scored(tallies: DataFrame, primary_field: Column) -> DataFrame:
    """Coverage, primary hit rate, score and issues from the tallies of a run.

    The score starts at 1, is halved for low coverage and cut by 0.7 for a sparse first field;
    a run without records scores 0.
    """
    n = F.coalesce("n_records", F.lit(0))
    empty = n == 0
    coverage = F.when(F.col("n_cells") > 0, F.col("n_filled") / F.col("n_cells")).otherwise(0.0)
    primary = F.when(empty, 0.0).otherwise(F.col("primary_hits") / n)
    low, sparse = F.col("coverage") < LOW_COVERAGE, F.col("primary_rate") < LOW_PRIMARY
    percent = F.format_string("%.0f", F.bround(F.col("coverage") * 100, 0))
    score = F.when(low, COVERAGE_FACTOR).otherwise(1.0) * F.when(sparse, PRIMARY_FACTOR).otherwise(1.0)
    issues = F.array_compact(
        F.array(
            F.when(low, F.concat(F.lit("Overall field coverage low ("), percent, F.lit("%)"))),
            F.when(
                sparse,
                F.format_string(
                    "Primary field '%s' sparse (%d/%d)", primary_field, F.col("primary_hits"), n
                ),
            ),
        )
    )
    return (
        tallies.withColumn("coverage", coverage)
        .withColumn("primary_rate", primary)
        .withColumn("n_records", n)
        .withColumn("score", F.when(empty, 0.0).otherwise(F.round(score, 2)))
        .withColumn(
            "issues", F.when(empty, F.array(F.lit("No records extracted"))).otherwise(issues)
        )
    )


def run_quality(records: DataFrame, runs: DataFrame, by_attempt: bool = False) -> DataFrame:
    """Quality of every run (and attempt); a run without records scores 0."""
    keys = ["run_id", "attempt"] if by_attempt else ["run_id"]
    tallies = record_tallies(records, runs, keys)
    primary = runs.select("run_id", field_names(F.col("fields"))[0].alias("_primary"))
    joined = primary.join(tallies, "run_id", "left")
    columns = [*keys, "n_records", "coverage", "primary_rate", "score", "issues"]
    return scored(joined, F.col("_primary")).select(*columns)


def select_attempts(quality: DataFrame, retries: int = MAX_RETRIES) -> DataFrame:
    """(run_id, attempt): the first attempt that scores at least 0.5, else the last one up to ``retries``.

    A run without records has no attempt of its own; all its retries were in vain.
    """
    tried = quality.withColumn("attempt", F.coalesce("attempt", F.lit(retries))).where(
        F.col("attempt") <= retries
    )
    accepted = F.min(F.when(F.col("score") >= ACCEPTED_SCORE, F.col("attempt")))
    return tried.groupBy("run_id").agg(
        F.coalesce(accepted, F.max("attempt")).alias("attempt")
    )


def run_summary(
    runs: DataFrame, merged: DataFrame, papers: DataFrame, chosen: DataFrame, errors: DataFrame
) -> DataFrame:
    """Per run: records, papers, retries, errors and the first five error messages."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count("*").alias(name))

    first_five = (
        prefix_cap(errors, ["run_id"], ["stage", "ref", "message"], 5, rank_name="_no")
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct("_no", "message"))).alias("_e"))
        .select("run_id", F.col("_e.message").alias("first_errors"))
    )
    out = runs.select("run_id")
    for part in (
        counted(merged, "n_records"), counted(papers, "n_papers"),
        chosen.select("run_id", F.col("attempt").alias("n_retries")),
        counted(errors, "n_errors"), first_five,
    ):
        out = out.join(part, "run_id", "left")
    return out.fillna(0, ["n_records", "n_papers", "n_retries", "n_errors"])
