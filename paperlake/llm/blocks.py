"""Comparing the rows of a bucket in blocks.

A bucket of n rows is split by a hash into blocks of about ``size`` rows, and each pair of blocks
becomes a group of its own, so a task never holds more than two blocks, however large the bucket is. A
row goes to as many groups as its bucket has blocks. Groups are dealt out by a hash and read in
order, one after the other; nothing gathers a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 1024


def block_pairs(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """``rows`` (key, n, cid, ...) with the pair of blocks (i, j) of each group and the row's own block."""
    many = F.ceil(F.col("n") / size)
    split = rows.withColumn("blk", F.pmod(F.xxhash64("cid"), many).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (many - 1).cast("int")))
    )
    return split.select(
        "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"),
        *[c for c in rows.columns if c not in ("key", "n")], "blk",
    )


def map_groups(
    rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str
) -> DataFrame:
    """``work`` on every group (key, i, j) of ``rows``. Rows are sorted within partitions and groups are
    handed on as they end, so memory holds one batch and one group."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist(), len(batch)]
            done = []
            for s, e in zip(starts, starts[1:], strict=False):
                part = batch.iloc[s:e]
                if held and tuple(held[0][["key", "i", "j"]].iloc[0]) != tuple(marks[s]):
                    done.append(held)
                    held = []
                held.append(part)
            out = [work(pd.concat(g) if len(g) > 1 else g[0]) for g in done]
            out = [x for x in out if x is not None and len(x)]
            if out:
                yield pd.concat(out)[columns]
        if held:
            last = work(pd.concat(held) if len(held) > 1 else held[0])
            if last is not None and len(last):
                yield last[columns]

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(run, schema)


def allowed_pairs(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of the two sides of a group: the same rows twice within one block."""
    i, j, blk = group["i"].iloc[0], group["j"].iloc[0], group["blk"].to_numpy()
    return np.flatnonzero(blk == i), np.flatnonzero(blk == j)
