"""The first hits of every query and strategy, without building the others.

The inverted index is cut into blocks of ascending paper ids. A block taken as one big paper tells the most that any
paper in it can reach: a strategy that the block's tokens do not satisfy finds nothing there, and no paper matches
more keywords than the block does. So each query and strategy visits blocks from the highest bound down, in order of
ids among equals, one block first, then two, then four. It is done when it has its number of hits and no paper of the
blocks ahead could stand before the last of them. Rounds are a loop over DataFrames: queries that are done leave, and
a round reads only the blocks that some query still visits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators import match
from paperlake.operators.queries import query_keywords
from paperlake.operators.ranking import prefix_cap
from paperlake.session import materialise, scratch_path, sized_side

KEYS = ["run_id", "query_no", "strategy_no"]


def blocked_postings(corpus: DataFrame, n_blocks: int = 64) -> DataFrame:
    """(paper_id, token, place, block): the token index, written by blocks of ascending ids, one folder per block.

    ``n_blocks`` may grow with the corpus; a round collects the numbers of the blocks it reads, at most so many.
    """
    spark = corpus.sparkSession
    index = match.token_index(corpus).repartitionByRange(n_blocks, "paper_id")
    placed = index.withColumn("block", F.spark_partition_id()).sortWithinPartitions("token", "paper_id")
    path = scratch_path(spark, "postings")
    placed.write.partitionBy("block").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def block_turns(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(run_id, query_no, strategy_no, block, upper, turn): blocks a strategy may find something in, in their order."""
    asked = query_keywords(queries).select(F.col("keyword").alias("token")).distinct()
    summary = postings.join(sized_side(asked), "token", "left_semi").select(
        F.col("block").alias("paper_id"), "token", "place"
    ).distinct()
    best = match.strategy_hits(match.keyword_hits(queries, summary)).select(
        *KEYS, F.col("paper_id").alias("block"), F.col("matched").alias("upper")
    )
    order = Window.partitionBy(*KEYS).orderBy(F.desc("upper"), "block")
    return best.withColumn("turn", F.row_number().over(order))


def hits_in_blocks(queries: DataFrame, postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Hits of the chosen (run_id, query_no, strategy_no, block), a written table, with their block."""
    numbers = [r["block"] for r in chosen.select("block").distinct().collect()]
    asked = query_keywords(queries).join(
        chosen.select("run_id", "query_no", "block").distinct(), ["run_id", "query_no"]
    ).withColumnRenamed("keyword", "token")
    found = postings.where(F.col("block").isin(numbers)).join(sized_side(asked), ["block", "token"])
    hits = match.strategy_hits(match.places(found, "block", "paper_id"), "block")
    return hits.join(sized_side(chosen.select(*KEYS, "block")), [*KEYS, "block"], "left_semi")


def first_hits(queries: DataFrame, postings: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """(run_id, query_no, strategy_no, paper_id, matched): the first ``bound`` hits of each strategy of each query.

    ``limits`` holds (run_id, bound), ``most`` is the largest bound. Hits stand in order of matched keywords, then id.
    """
    queries, bounds = materialise(queries, "queries"), sized_side(materialise(limits.select("run_id", "bound"), "bounds"))
    turns = materialise(block_turns(queries, postings), "turns")
    shown = [*KEYS, "paper_id", "matched"]
    open_keys, kept, parts, seen, width = sized_side(turns.select(*KEYS).distinct()), None, [], 0, 1
    while True:
        ahead = turns.where(F.col("turn").between(seen + 1, seen + width))
        chosen = materialise(ahead.join(open_keys, KEYS, "left_semi"), "chosen")
        found = hits_in_blocks(queries, postings, chosen).select(*shown, "block")
        if kept is not None:
            found = kept.join(open_keys, KEYS, "left_semi").select(*shown, "block").unionByName(found)
        kept = materialise(prefix_cap(
            found.join(bounds, "run_id"), KEYS, [F.desc("matched"), "paper_id"], F.col("bound"),
            rank_name="position", most=most,
        ), "first-hits")
        seen, width = seen + width, 2 * width
        last = kept.where(F.col("position") == F.col("bound")).select(
            *KEYS, F.col("matched").alias("least"), F.col("block").alias("at")
        )
        settled = (F.col("least") > F.col("upper")) | ((F.col("least") == F.col("upper")) & (F.col("at") < F.col("block")))
        visiting = turns.where(F.col("turn") == seen + 1).join(open_keys, KEYS, "left_semi")
        to_come = visiting.join(last, KEYS, "left")
        still = materialise(to_come.where(~F.coalesce(settled, F.lit(False))).select(*KEYS), "open")
        if still.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, kept.select(*shown)])
        open_keys = sized_side(still)
        parts.append(kept.join(open_keys, KEYS, "left_anti").select(*shown))
