"""Incremental harvest: landed pages in, papers with titles not seen before out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlake.functions.text import title_key
from paperlake.operators.ranking import first_wins
from paperlake.streaming.seen import SeenTitles


def titled(papers: DataFrame) -> DataFrame:
    """Papers with a title, with its key."""
    return papers.withColumn("title_key", title_key(F.col("title"))).where(F.coalesce("title_key", F.lit("")) != "")


def harvest(
    papers: DataFrame, table: str, checkpoint: str, order: Sequence[str] = ("paper_id",), seen: SeenTitles | None = None
) -> StreamingQuery:
    """Run all landed papers, batch by batch, into a Parquet table of papers with new titles.

    Arrival order of batches decides which paper of a title stays; within a batch ``order`` does. Each batch writes its
    own ``batch_id`` folder. ``seen``, by default a folder next to the table, keeps the titles of earlier batches; a
    replayed batch looks at earlier ones only and rewrites the same rows.
    """
    known = seen or SeenTitles(f"{table}_seen")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{table}/batch_id={batch_id}"
        firsts = first_wins(titled(batch), ["title_key"], order)
        fresh = known.unseen(firsts, batch_id)
        fresh.write.mode("overwrite").parquet(target)
        known.add(spark.read.schema(fresh.schema).parquet(target), batch_id)

    return (
        papers.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_arrivals(papers: DataFrame, delay: str | None = None, time: str = "arrived") -> DataFrame:
    """Streaming form that keeps the titles in the state store.

    Which paper of a title within one batch stays is not defined here. With ``delay``, keys are
    forgotten once the watermark on ``time`` has passed them.
    """
    keyed = titled(papers)
    if delay is None:
        return keyed.dropDuplicates(["title_key"])
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["title_key"])


def first_by_order(
    papers: DataFrame, delay: str, order: Sequence[str] = ("arrived", "paper_id"), time: str = "arrived"
) -> DataFrame:
    """Streaming form in the state store with a defined winner.

    Arrivals of a title that are less than ``delay`` apart belong together; of each such stretch the first paper in
    ``order``, which should be total, stays, however the feed is cut into batches. It is given out once the watermark
    has passed the stretch's end, and its state is dropped; the title counts as new after that. Papers without a
    time take no part, nor do those that arrive behind the watermark. On a batch DataFrame the same rows come at once.
    """
    keyed = titled(papers).withWatermark(time, delay)
    first = F.min_by(F.struct(*papers.columns, "title_key"), F.struct(*order)).alias("_first")
    return keyed.groupBy("title_key", F.session_window(time, delay).alias("_stretch")).agg(first).select("_first.*")
