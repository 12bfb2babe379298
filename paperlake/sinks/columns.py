"""From open-schema records to ordered columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import key_name
from paperlake.operators.ranking import number_rows
from paperlake.operators.rows import one_row_each
from paperlake.session import materialise

#: Most columns whose values are looked up in a record one by one; a look-up passes over the record's keys.
FEW_COLUMNS = 64


def record_keys(records: DataFrame) -> DataFrame:
    """(key): distinct record keys without internal ones."""
    return (
        one_row_each(records, [], F.map_keys("fields"), "key")
        .where(~F.startswith("key", F.lit("_")))
        .distinct()
    )


def ordered_columns(records: DataFrame, fields: Sequence[str]) -> list[str]:
    """Requested fields that occur, then the other keys in alphabetical order.

    The names are what a header holds in one line, so the driver never holds more than the header.
    """
    found = {r["key"] for r in record_keys(records).toLocalIterator()}
    spark = records.sparkSession
    names = spark.range(1).select(
        F.array_distinct(F.transform(F.array(*map(F.lit, fields)), key_name))
    ).first()[0]
    asked = [f for f in names if f in found]
    return asked + sorted(found - set(asked))


def numbered_columns(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(at, key) of the columns in the order of :func:`ordered_columns`, from 0; the names stay on the executors."""
    asked = records.sparkSession.range(1).select(
        F.posexplode(F.array_distinct(F.transform(F.array(*map(F.lit, fields)).cast("array<string>"), key_name))).alias("place", "key")
    )
    placed = record_keys(records).join(F.broadcast(asked), "key", "left").select(
        F.coalesce("place", F.lit(len(fields))).alias("place"), "key"
    )
    return number_rows(placed, [], ["place", "key"], "at").select((F.col("at") - 1).cast("int").alias("at"), "key")


def with_cells(records: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``records`` with ``cells`` instead of ``fields``, one row of ``names``): names and values by position.

    With few columns each is looked up in the record. Else the records' own entries meet their positions in a join and
    the gaps between them are filled with NULL, so the work is in proportion to the entries and the cells put out.
    ``records`` and ``columns``, from :func:`numbered_columns`, should be written tables.
    """
    n = columns.count()
    names = columns.agg(F.array_sort(F.collect_list(F.struct("at", "key")))["key"].alias("names"))
    if n <= FEW_COLUMNS:
        found = names.first()["names"]
        return records.withColumn("cells", cells(found)).drop("fields"), names
    marked = materialise(records.withColumn("_id", F.monotonically_increasing_id()), "cell-records")
    entries = marked.select("_id", F.explode("fields").alias("key", "value")).join(columns, "key")
    placed = entries.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_s"))
    none = F.lit(None).cast("string")

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("_s"), i - 1)["at"]).otherwise(-1)
        return F.concat(F.array_repeat(none, entry["at"] - before - 1), F.array(entry["value"]))

    last = F.coalesce(F.get(F.col("_s"), F.size("_s") - 1)["at"], F.lit(-1))
    values = F.concat(
        F.coalesce(F.flatten(F.transform("_s", with_gap)), F.array().cast("array<string>")), F.array_repeat(none, F.lit(n - 1) - last)
    )
    joined = marked.drop("fields").join(placed, "_id", "left").withColumn("cells", values)
    return joined.drop("_id", "_s"), names


def names_array(columns: Sequence[str]) -> Column:
    """The names as one constant array, however many there are."""
    return F.from_json(F.lit(json.dumps(list(columns))), "array<string>")


def cells(columns: Sequence[str]) -> Column:
    """A record's values by position, NULL where it lacks the key: one array instead of a column per key."""
    return F.transform(names_array(columns), lambda k: F.col("fields")[k])


def wide(records: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One text column per key, NULL where a record lacks it."""
    return records.select(*keep, *[F.col("fields")[k].alias(k) for k in columns])


def preview(
    records: DataFrame, fields: Sequence[str], order: Sequence[str], rows: int = 10,
    columns: int = 5, width: int = 38,
) -> DataFrame:
    """The first records with the first requested fields that occur, cells cut to ``width``."""
    found = ordered_columns(records, fields)
    names = records.sparkSession.range(1).select(
        F.array(*[key_name(F.lit(f)) for f in fields])
    ).first()[0]
    shown = [c for c in found if c in set(names)][:columns]
    head = records.orderBy(*order).limit(rows)
    return head.select(
        *order,
        *[F.substring(F.coalesce(F.col("fields")[c], F.lit("")), 1, width).alias(c) for c in shown],
    )
