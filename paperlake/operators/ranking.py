"""First-wins deduplication, prefix caps and numbering under a carried total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.session import materialise

#: Up to this limit Spark prunes ``row_number() <= n`` before the shuffle.
MAP_SIDE_LIMIT = 1000


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_wins(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]
) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark limits ``row_number() = 1`` to one row per key on the map side already, so a key that
    holds a third of the table sends one row per input partition through the shuffle.
    """
    window = Window.partitionBy(*_columns(keys)).orderBy(*_columns(order))
    return (
        df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")
    )


def prefix_cap(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    cap: int | Column,
    rank_name: str | None = None,
    most: int | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first ``cap`` rows per key in ``order``; ``rank_name`` keeps the position.

    ``most`` is the largest value of a cap that is a column. A cap known to be at most 1000 is
    pruned map-side by Spark. Any other cap goes through a salted stage first: a hot key is cut
    to ``cap`` rows in each of ``salts`` parts, then once more in the union of the parts. The
    first ``cap`` rows overall are among the firsts of their parts, so the result is the same.
    The salt comes from the order columns given by name.
    """
    order_by = _columns(order)
    rank = rank_name or "_rn"
    limit = F.lit(cap) if isinstance(cap, int) else cap
    most = cap if isinstance(cap, int) else most
    within = F.col(rank) <= limit
    if most is not None and most <= MAP_SIDE_LIMIT:
        within = within & (F.col(rank) <= most)
    else:
        spread = [c for c in order if isinstance(c, str)]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order_by)
        df = (
            salted.withColumn("_part_rn", F.row_number().over(part))
            .where(F.col("_part_rn") <= limit)
            .drop("_salt", "_part_rn")
        )
    whole = Window.partitionBy(*keys).orderBy(*order_by)
    out = df.withColumn(rank, F.row_number().over(whole)).where(within)
    return out if rank_name else out.drop(rank)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "record_no"
) -> DataFrame:
    """Number the rows of each key 1, 2, 3 … in ``order`` without sorting a key in one task.

    Rows are range-partitioned by (keys, order) and written once; each partition numbers its own
    rows per key, and the counts of the earlier partitions, a table of one row per partition and
    key, are added.
    """
    placed = materialise(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()),
        "numbered",
    )
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    return (
        placed.withColumn("_within", F.row_number().over(within))
        .join(offsets, ["_part", *keys])
        .withColumn(name, F.col("_within") + F.col("_offset"))
        .drop("_part", "_within", "_offset")
    )
