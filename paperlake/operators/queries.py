"""Search queries of a run and the keywords of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.noisy_json import query_list
from paperlake.functions.text import expand_queries, filter_words, keywords
from paperlake.operators.rows import one_row_each

#: Keywords beyond this position take part in no strategy.
USED_KEYWORDS = 6


def run_queries(runs: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """(run_id, query_no, query, n_queries): one row per search query.

    ``responses`` (run_id, response, and attempt if there are several) may bring query lists; the
    first attempt with a usable list counts, ties by text. A run without one gets the three
    queries made from its prompt.
    """
    own = expand_queries(F.col("prompt"))
    if responses is not None:
        attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(0)
        listed = responses.select(
            "run_id", F.struct(attempt.alias("n"), "response", query_list(F.col("response")).alias("q")).alias("_r")
        ).where(F.size("_r.q") > 0)
        first = listed.groupBy("run_id").agg(F.min("_r").alias("_r"))
        runs = runs.join(first.select("run_id", F.col("_r.q").alias("_listed")), "run_id", "left")
        own = F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(own)
    return runs.select("run_id", own.alias("_queries")).select(
        "run_id",
        F.posexplode("_queries").alias("query_no", "query"),
        F.size("_queries").alias("n_queries"),
    )


def per_query_budget(max_papers: Column, n_queries: Column) -> Column:
    """Papers a single query may bring: an even share of the run's cap, at least 50."""
    share = F.floor(max_papers / F.greatest(n_queries, F.lit(1)))
    return F.greatest(share, F.lit(50)).cast("int")


def fetch_bound(budget: Column, page_limit: int = 100) -> Column:
    """Rows one strategy may bring: whole pages of ``min(budget, 100)`` rows."""
    page = F.least(budget, F.lit(page_limit))
    return (F.ceil(budget / page) * page).cast("int")


def query_keywords(queries: DataFrame) -> DataFrame:
    """(run_id, query_no, keyword, mask, n_keywords) for queries that have keywords.

    ``mask`` has one bit per position of the keyword among the first six, so a keyword that
    is repeated in a query still counts for each of its positions.
    """
    kw = queries.select("run_id", "query_no", keywords(F.col("query")).alias("_kw"))
    used = kw.select(
        "run_id", "query_no", F.size("_kw").alias("n_keywords"),
        F.posexplode(F.slice("_kw", 1, USED_KEYWORDS)).alias("_pos", "keyword"),
    )
    return used.groupBy("run_id", "query_no", "keyword", "n_keywords").agg(
        F.bit_or(F.expr("shiftleft(1, _pos)")).alias("mask")
    )


def filter_keywords(runs: DataFrame) -> DataFrame:
    """(run_id, keyword, times) used by the substring filter, with repeats counted."""
    return (
        one_row_each(runs, ["run_id"], filter_words(F.col("prompt")), "keyword")
        .groupBy("run_id", "keyword")
        .agg(F.count("*").cast("int").alias("times"))
    )
