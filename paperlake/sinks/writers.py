"""CSV, JSON and text output.

Records are written in order across the part files, whose names sort in that order: the parts put one after the other are the
file a single writer would give. So a CSV has one header, in its first part, and a JSON array opens in the first
part and closes in the last. Each writer reads its records once; Spark's commit makes all parts visible together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators.ranking import number_rows
from paperlake.session import materialise
from paperlake.sinks.columns import names_array, numbered_columns, with_cells

ORDER = ("run_id", "paper_no", "element_no")
RULE = "─" * 60


def csv_cell(value: Column) -> Column:
    """A CSV cell, quoted only when it holds a comma, a quote or a line break."""
    text = F.coalesce(value, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def _write_lines(lines: DataFrame, order: Sequence[str], path: str, end: str, before: DataFrame | Column | None = None,
                 after: Column | None = None) -> None:
    """Write ``line`` in ``order``, with one line before all others and one after them; either may be a table of one ``line``."""
    whole = lines.withColumn("_at", F.lit(1))
    blank = lines.limit(0)
    spark = lines.sparkSession
    for at, line in ((0, before), (2, after)):
        if line is not None:
            one = line if isinstance(line, DataFrame) else spark.range(1).select(line.alias("line"))
            row = one.select(*[F.lit(None).cast(t).alias(c) for c, t in blank.dtypes if c != "line"], "line")
            whole = whole.unionByName(row.withColumn("_at", F.lit(at)))
    whole.orderBy("_at", *order).select("line").write.option("lineSep", end).text(path)


def write_csv(
    records: DataFrame, fields: Sequence[str], path: str, order: Sequence[str] = ORDER
) -> bool:
    """CSV with one header, missing values empty, CRLF after each record; any number of keys.

    Written as text: the CSV writer would turn line breaks inside values into CRLF, too.
    """
    records = materialise(records.select(*order, "fields"), "csv-records")
    if records.isEmpty():
        return False
    columns = materialise(numbered_columns(records, fields), "csv-columns")
    placed, names = with_cells(records, columns)
    line = F.array_join(F.transform("cells", csv_cell), ",")
    line = F.when((F.size("cells") == 1) & (line == ""), F.lit('""')).otherwise(line)
    header = names.select(F.array_join(F.transform("names", csv_cell), ",").alias("line"))
    lines = materialise(placed.select(*order, line.alias("line")), "csv-lines")  # a sort evaluates its input twice
    _write_lines(lines, order, path, "\r\n", before=header)
    return True


def write_json(
    records: DataFrame, path: str, include_internal: bool = False, order: Sequence[str] = ORDER, array: bool = False
) -> bool:
    """JSON lines, or one JSON array with a record on each line; an object holds the keys its record has.

    The keys need not be known beforehand, so nothing is gathered on the driver. For an array, ``order`` must
    identify a record: the first one has no comma before it.
    """
    fields = F.col("fields")
    if include_internal:
        fields = F.map_concat(
            F.map_filter(fields, lambda k, _: ~k.isin("_source_url", "_source")),
            F.create_map(F.lit("_source_url"), F.col("source_url"),
                         F.lit("_source"), F.col("source")),
        )
    else:
        fields = F.map_filter(fields, lambda k, _: ~F.startswith(k, F.lit("_")))
    lines = materialise(records.select(*order, F.to_json(fields).alias("line")), "json-lines")
    if lines.isEmpty():
        return False
    if not array:
        _write_lines(lines, order, path, "\n")
        return True
    first = lines.agg(F.min(F.struct(*order)).alias("f")).first()["f"]
    opens = F.lit(True)
    for c in order:
        opens = opens & F.col(c).eqNullSafe(F.lit(first[c]))
    lines = lines.withColumn("line", F.concat(F.when(opens, " ").otherwise(","), "line"))
    _write_lines(lines, order, path, "\n", before=F.lit("["), after=F.lit("]"))
    return True


def write_text(
    records: DataFrame, fields: Sequence[str], path: str, order: Sequence[str] = ORDER
) -> bool:
    """Framed, numbered records; numbers start at 1 in each run."""
    records = materialise(records.select(*order, "fields"), "text-records")
    if records.isEmpty():
        return False
    columns = materialise(numbered_columns(records, fields), "text-columns")
    numbered, names = with_cells(number_rows(records, list(order[:1]), list(order[1:])), columns)
    shown = F.zip_with(
        names_array(names.first()["names"]), "cells",
        lambda k, v: F.format_string("  %-26s: %s", k, F.coalesce(v, F.lit(""))),
    )
    head = F.format_string(f"{RULE}\nRecord %d\n{RULE}", "record_no")
    framed = F.concat(head, F.lit("\n"), F.array_join(shown, "\n"), F.lit("\n"))
    _write_lines(numbered.select(*order, framed.alias("line")), order, path, "\n")
    return True
