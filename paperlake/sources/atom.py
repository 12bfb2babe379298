"""Atom feed pages, as files or as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.paper import author_list, category_list, doi_link, pdf_link
from paperlake.functions.text import collapse, date_prefix, strip
from paperlake.functions.vocab import ATOM_SOURCE
from paperlake.operators.rows import one_row_each
from paperlake.sources.papers import as_papers

# Arrays are declared because inference makes a struct of an element that occurs once.
ENTRY_FIELDS = (
    "id string, title string, summary string, published string, "
    "author array<struct<name: array<string>>>, "
    "link array<struct<_href: string, _title: string>>, "
    "`arxiv:primary_category` array<struct<_term: string>>, "
    "category array<struct<_term: string>>"
)
_CORRUPT = "_corrupt_record"


def _raw_entries(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", "entry").option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(f"{ENTRY_FIELDS}, {_CORRUPT} string")
        .load(path)
        .withColumn("page", F.col("_metadata.file_path"))
    )


def malformed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page) of every page file that is not well-formed."""
    # Spark wants a second data column next to the corrupt-record column; any test on id will do.
    some_id = F.length(F.coalesce("id", F.lit(""))) >= 0
    faults = _raw_entries(spark, path).where(F.col(_CORRUPT).isNotNull() & some_id)
    return faults.select("page").distinct()


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Papers of landed Atom pages. A malformed page contributes nothing.

    The reader keeps the entries before a fault, so pages with a fault are taken out whole.
    """
    pages = _raw_entries(spark, path)
    whole = pages.join(malformed_pages(spark, path), "page", "left_anti")
    return entries_to_papers(whole, ["page"])


def atom_column(pages: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Papers of Atom pages held in a text column; a malformed page contributes nothing."""
    feed = F.from_xml(F.col(column), f"entry array<struct<{ENTRY_FIELDS}>>")
    entries = one_row_each(pages, keep, feed["entry"], "_entry")
    return entries_to_papers(entries.select(*keep, "_entry.*"), keep)


def entries_to_papers(entries: DataFrame, keep: list[str]) -> DataFrame:
    """Papers of feed entries; entries without a title are skipped."""
    blank = F.lit("")
    links = F.transform(
        F.coalesce("link", F.array().cast("array<struct<_href:string,_title:string>>")),
        lambda k: F.struct(k["_href"].alias("href"), k["_title"].alias("title")),
    )
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform("author", lambda a: F.try_element_at(a["name"], F.lit(1))), none)
    terms = lambda c: F.coalesce(F.col(c)["_term"], none)
    shaped = entries.select(
        *keep,
        strip(F.coalesce("id", blank)).alias("paper_id"), strip(F.coalesce("id", blank)).alias("url"),
        collapse(F.coalesce("title", blank)).alias("title"),
        collapse(F.coalesce("summary", blank)).alias("abstract"),
        author_list(names).alias("authors"),
        category_list(terms("`arxiv:primary_category`"), terms("category")).alias("categories"),
        date_prefix(strip(F.coalesce("published", blank))).alias("published_text"),
        doi_link(links).alias("_doi"), pdf_link(links).alias("pdf_url"),
        F.lit(ATOM_SOURCE).alias("source"),
    ).where(F.col("title") != "")
    return as_papers(
        shaped, doi_shown=F.col("_doi"),
        doi_meta=F.when(F.col("_doi") != "", F.col("_doi")).otherwise(F.col("paper_id")),
        category_label="CATEGORIES", extra=keep,
    )
