"""The common shape of papers from both feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.paper import text_block
from paperlake.functions.text import date_prefix, doi_norm, title_key
from paperlake.functions.vocab import META_KEYS

#: Columns every reader here delivers.
PAPER_COLUMNS = [
    "paper_id", "url", "title", "abstract", "authors", "categories", "published", "doi_norm",
    "text", "meta",
]


def as_papers(
    df: DataFrame, *, doi_shown: Column, doi_meta: Column, category_label: str, extra: list[str]
) -> DataFrame:
    """Adds date, text block and metadata to (paper_id, url, title, abstract, authors,
    categories, published_text, pdf_url, source)."""
    authors = F.array_join("authors", ", ")
    categories = F.array_join("categories", ", ")
    day = F.col("published_text")
    text = text_block(
        F.col("title"), authors, day, doi_shown, categories, F.col("abstract"), category_label
    )
    values = {
        "title": F.col("title"), "authors": authors, "published_date": day, "doi": doi_meta,
        "url": F.col("url"), "pdf_url": F.col("pdf_url"), "categories": categories,
        "source": F.col("source"),
    }
    meta = F.struct(*[values[k].alias(k) for k in META_KEYS])
    return df.select(
        "paper_id", "url", "title", "abstract", "authors", "categories",
        F.try_to_date(date_prefix(day), "yyyy-MM-dd").alias("published"),
        doi_norm(doi_meta).alias("doi_norm"), text.alias("text"), meta.alias("meta"), *extra,
    )


def usable(papers: DataFrame) -> DataFrame:
    """Papers with a title and an id."""
    return papers.where((title_key(F.col("title")) != "") & (F.col("paper_id") != ""))


def rejects(papers: DataFrame, stage: str) -> DataFrame:
    """(run_id, stage, ref, message) for papers :func:`usable` drops."""
    no_title = F.coalesce(title_key(F.col("title")), F.lit("")) == ""
    no_id = F.coalesce(F.col("paper_id"), F.lit("")) == ""
    return papers.where(no_title | no_id).select(
        F.lit(None).cast("bigint").alias("run_id"), F.lit(stage).alias("stage"),
        F.coalesce("paper_id", F.lit("")).alias("ref"),
        F.when(no_title, "no title").otherwise("no id").alias("message"),
    )
