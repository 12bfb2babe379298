"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]"
SPANS = "array<struct<start:int,end:int,value:string,left:string>>"
#: Characters kept of the text before a span.
LEFT_CHARS = 80


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that no column of ``df`` has, for helpers that travel with foreign columns."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a whole text: runs of anything but ASCII white space; none in a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP + "+"), lambda w: w != "")


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of numbers, by doubling distances: n log n steps in the row."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")))
    return F.aggregate(
        F.coalesce(steps, F.array().cast("array<int>")),
        values,
        lambda acc, d: F.transform(
            acc,
            lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), d).cast("int")), F.lit(0)),
        ),
    )


def spans(
    text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, left: int | None = LEFT_CHARS
) -> Column:
    """Leftmost non-overlapping matches of a Java pattern: start and end in code points, the text
    and what stands between it and the match before: its last ``left`` characters, or all of it.

    The pieces between the matches and the matches themselves give the places. Matches that
    ``keep`` refuses drop out; their characters are not searched again.
    """

    def placed(hits: Column) -> Column:
        def of(pieces: Column) -> Column:
            lengths = F.zip_with(
                F.slice(pieces, F.lit(1), F.size(hits)),
                hits,
                lambda p, h: (F.char_length(p) + F.char_length(h)),
            )
            return let(
                lengths,
                lambda n: let(
                    prefix_sums(n),
                    lambda ends: F.transform(
                        ends,
                        lambda e, i: F.struct(
                            (e - F.char_length(F.get(hits, i))).cast("int").alias("start"),
                            e.cast("int").alias("end"),
                            F.get(hits, i).alias("value"),
                            (F.get(pieces, i) if left is None else F.substring(F.get(pieces, i), -left, left)).alias("left"),
                        ),
                    ),
                ),
            )

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), of))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["value"]))
    return F.coalesce(found, F.array().cast(SPANS))


def joined_spans(found: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def tagged(found: Column, kind: str, order: int) -> Column:
    """Spans with their kind, sortable by kind order or by start."""
    return F.transform(
        found,
        lambda s: F.struct(
            F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )
