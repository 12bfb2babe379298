"""Preprint JSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.paper import doi_url, preprint_pdf_url
from paperlake.functions.text import strip, title_key
from paperlake.functions.vocab import PREPRINT_SOURCES
from paperlake.sources.papers import as_papers

_ITEM = ", ".join(
    f"{name}: string"
    for name in ("title", "abstract", "authors", "doi", "date", "category", "version")
)
PAGE_SCHEMA = f"collection array<struct<{_ITEM}>>, _corrupt_record string"


def read_preprint_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Raw items of one server's landed pages with their place: (page, page_pos, source, …)."""
    pages = (
        spark.read.option("multiLine", True).schema(PAGE_SCHEMA).json(path)
        .withColumn("page", F.col("_metadata.file_path"))
    )
    return pages.select(
        "page", F.posexplode("collection").alias("page_pos", "_i"), F.lit(source).alias("source")
    ).select("page", "page_pos", "source", "_i.*")


def malformed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page) of every page file that is not JSON."""
    pages = spark.read.option("multiLine", True).schema(PAGE_SCHEMA).json(path)
    # Spark wants a second data column next to the corrupt-record column.
    no_items = F.coalesce(F.size("collection"), F.lit(0)) <= 0
    return pages.where(F.col("_corrupt_record").isNotNull() & no_items).select(
        F.col("_metadata.file_path").alias("page")
    )


def by_number(path: Column) -> Column:
    """A key by which page 2 sorts before page 10: each number of a path stands behind its count of digits."""
    parts = F.regexp_extract_all(path, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    key = F.transform(parts, lambda p: F.when(
        p.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(p, F.lit("0")))
    ).otherwise(p))
    return F.array_join(key, "").alias("number")


def items_to_papers(items: DataFrame) -> DataFrame:
    """Papers of preprint items, with ``server_no`` and a feed order by page number and place.

    An item without a DOI has no address; its source and title identify it.
    """
    blank = F.lit("")
    text = lambda c: strip(F.coalesce(F.col(c), blank))
    doi = F.coalesce("doi", blank)
    server = F.array_position(F.array(*map(F.lit, PREPRINT_SOURCES)), F.col("source")) - 1
    shaped = items.select(
        "source", "page", "page_pos", text("title").alias("title"), text("abstract").alias("abstract"),
        F.array_compact(F.array(F.when(text("authors") != "", text("authors")))).alias("authors"),
        F.array_compact(F.array(F.col("category"))).alias("categories"),
        F.coalesce("date", blank).alias("published_text"), doi.alias("doi"),
        doi_url(doi).alias("url"),
        preprint_pdf_url(doi, F.coalesce("version", F.lit("1")), F.col("source")).alias("pdf_url"),
        server.cast("int").alias("server_no"),
    ).withColumn(
        "paper_id",
        F.when(F.col("url") != "", F.col("url")).otherwise(
            F.concat_ws(":", "source", title_key(F.col("title")))
        ),
    )
    return as_papers(
        shaped, doi_shown=F.col("doi"), doi_meta=F.col("doi"), category_label="CATEGORY",
        extra=["server_no", "page", "page_pos"],
    ).withColumn("feed_pos", F.struct(by_number(F.col("page")), "page", "page_pos")).drop("page", "page_pos")
