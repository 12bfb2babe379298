"""Landed feed pages as a stream: whole pages in, papers and errors out, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlake.session import materialise
from paperlake.sources import atom, preprint
from paperlake.sources.papers import rejects, usable


@dataclass(frozen=True)
class Feed:
    """How the pages of a feed are read.

    ``parse`` makes a struct of ``items`` and ``faulty`` of a page's text. ``papers`` makes papers of
    (page, page_pos, the items' fields).
    """

    stage: str
    parse: Callable[[Column], Column]
    papers: Callable[[DataFrame], DataFrame]


def _result(parsed: Column, items: str, faulty: Callable[[Column], Column]) -> Column:
    """Items and fault of a parsed page; the array of one element makes Spark parse once."""
    shaped = F.transform(F.array(parsed), lambda p: F.struct(
        p[items].alias("items"), F.coalesce(p.isNull() | faulty(p), F.lit(True)).alias("faulty")
    ))
    return F.get(shaped, 0)


def atom_feed() -> Feed:
    """Atom pages; one that is not well-formed is a fault as a whole."""

    def parse(body: Column) -> Column:
        parsed = F.from_xml(body, f"entry array<struct<{atom.ENTRY_FIELDS}>>, _corrupt_record string")
        return _result(parsed, "entry", lambda p: p["_corrupt_record"].isNotNull())

    return Feed("atom", parse, lambda items: atom.entries_to_papers(items, ["page", "page_pos"]))


def preprint_feed(source: Column) -> Feed:
    """Preprint pages; ``source``, an expression over ``page``, names their server."""

    def parse(body: Column) -> Column:
        return _result(F.from_json(body, preprint.PAGE_SCHEMA), "collection", lambda p: (
            p["_corrupt_record"].isNotNull() & (F.coalesce(F.size(p["collection"]), F.lit(0)) <= 0)
        ))

    return Feed("preprint", parse, lambda items: preprint.items_to_papers(items.withColumn("source", source)))


def page_stream(spark: SparkSession, path: str, pages_per_batch: int | None = None) -> DataFrame:
    """(page, body): every page file that lands under ``path``, whole."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if pages_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", pages_per_batch)
    return reader.load(path).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("body"))


#: Pages of a pack.
PACK_PAGES = 64


def write_packs(pages: DataFrame, path: str) -> None:
    """Pages (page, body) as packs, Parquet files of at most PACK_PAGES pages. A file for each page would cost more to make
    and to list than its papers cost to read."""
    pages.select("page", "body").write.option("maxRecordsPerFile", PACK_PAGES).parquet(path)


def packed_page_stream(spark: SparkSession, path: str, packs_per_batch: int | None = None) -> DataFrame:
    """(page, body): every page of the packs that land under ``path``."""
    reader = spark.readStream.schema("page string, body string")
    if packs_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", packs_per_batch)
    return reader.parquet(path)


def land_papers(pages: DataFrame, feed: Feed, table: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Papers of the pages into ``table``, malformed pages and unusable papers into ``errors``.

    Both are Parquet tables with a folder per ``batch_id``, so a replayed batch rewrites its rows. A page is parsed once;
    a page without text, like one that cannot be parsed, is a fault and gives no papers.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        cores = batch.sparkSession.sparkContext.defaultParallelism  # small files share scan tasks
        parsed = batch.repartition(cores).select("page", feed.parse(F.col("body")).alias("_r"))
        parsed = materialise(parsed.select("page", "_r.*"), "parsed")
        items = parsed.where(~F.col("faulty")).select("page", F.posexplode_outer("items").alias("page_pos", "_i"))
        found = feed.papers(items.where(F.col("_i").isNotNull()).select("page", "page_pos", "_i.*"))
        usable(found).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        faults = parsed.where("faulty").select(
            F.lit(None).cast("bigint").alias("run_id"), F.lit(feed.stage).alias("stage"),
            F.col("page").alias("ref"), F.lit("malformed page").alias("message"),
        )
        faults.unionByName(rejects(found, feed.stage)).write.mode("overwrite").parquet(f"{errors}/batch_id={batch_id}")

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
