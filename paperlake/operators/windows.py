"""Date windows of the preprint feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import sized_side

# Window borders in days before the reference day, most recent window first.
WINDOW_DAYS = ((30, 0), (90, 30), (180, 90))


def window_numbers(day: Column, as_of: Column) -> Column:
    """Numbers of the windows a day falls in; both borders belong to a window."""
    inside = [
        F.when(day.between(F.date_sub(as_of, old), F.date_sub(as_of, new)), F.lit(no))
        for no, (old, new) in enumerate(WINDOW_DAYS)
    ]
    return F.array_compact(F.array(*inside))


def date_windows(items: DataFrame, day: str | Column, as_of: Column) -> DataFrame:
    """Items with ``window_no``; a border day appears in both of its windows.

    The outer range is a plain comparison on the day, so it reaches the scan and prunes
    partitions of a corpus that is laid out by date.
    """
    day = F.col(day) if isinstance(day, str) else day
    reach = max(old for old, _ in WINDOW_DAYS)
    return items.where((day >= F.date_sub(as_of, reach)) & (day <= as_of)).withColumn(
        "window_no", F.explode(window_numbers(day, as_of))
    )


#: Days of a bucket in which items and reference days meet.
BUCKET_DAYS = 30


def date_windows_of(items: DataFrame, day: str, days: DataFrame) -> DataFrame:
    """Items in the windows of each reference day: columns of ``items``, ``as_of`` and ``window_no``.

    ``days`` (as_of) may hold any number of days. Items and days meet by equality of a bucket of days, of which a
    reference day reaches a fixed number, and the windows' borders are tested there; so no item is compared with a day
    whose windows lie elsewhere.
    """
    reach = max(old for old, _ in WINDOW_DAYS)
    bucket = lambda c: F.floor(F.unix_date(c) / BUCKET_DAYS)
    asked = days.select("as_of").where(F.col("as_of").isNotNull()).distinct()
    reached = asked.select(
        "as_of", F.explode(F.sequence(bucket(F.date_sub("as_of", reach)), bucket(F.col("as_of")))).alias("_bucket")
    )
    met = items.withColumn("_bucket", bucket(F.col(day))).join(sized_side(reached), "_bucket").drop("_bucket")
    return met.withColumn("window_no", F.explode(window_numbers(F.col(day), F.col("as_of"))))
