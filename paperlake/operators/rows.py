"""From arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row_each(
    df: DataFrame, keep: Sequence[str | Column], values: Column, name: str
) -> DataFrame:
    """One row per element of ``values``, none for an empty array; null elements drop out.

    A plain ``explode`` makes Spark add a filter on the size of the array, which computes the
    array a second time and, below a shuffle, even before the rows are spread. Tokenising or
    parsing twice costs more than the filter saves, so the outer form is used.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
