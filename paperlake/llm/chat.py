r"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once: the participant's turns as the
assistant's, everybody else's as those of a named user, system turns as such. The mask holds the spans of the
assistant's texts, in code points of the rendered text.

A dialogue is rendered whole, as part 0: a row of the result holds all of it. With ``turns_per_part`` it is rendered in parts of
so many turn numbers instead. Turns are gathered with map-side sets, participants in a table of their own.

A mark of the rendering that stands in a text or a role's name gets a backslash, ``<|`` as ``<\|``, and one more if it
has some, so that no text forges a turn and the escape can be undone; in names, ``|>`` as ``|\>`` and line ends as
``\n`` too. Masks count the escaped texts.

Rows without a conversation id are no dialogue of their own; they are always rendered in parts of ``LOOSE`` turn numbers.

Defined cases: null roles are the speaker ``unknown`` and null texts empty turns. A turn without a number comes first; where there are parts,
in part -1. Turns of one number follow by role, then text; a row that is repeated in
whole is the same turn and rendered once. A conversation of system turns alone has no participant
and gives no rows, and neither does an empty table.
Foreign columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import col, let, prefix_sums
from paperlake.session import materialise, sized_side

#: Turn numbers of a part of the rows without a conversation.
LOOSE = 256
SYSTEM, NOBODY = "system", "unknown"


def escaped(text: Column) -> Column:
    """A text without marks of the rendering."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def escaped_name(role: Column) -> Column:
    """A role's name without marks and line ends."""
    return F.replace(F.regexp_replace(escaped(role), r"\|(\\*+)>", r"|\\$1>"), F.lit("\n"), F.lit("\\n"))


def segment(turn: Column, perspective: Column) -> Column:
    """One rendered turn: a head line, the text, a line end."""
    head = (
        F.when(turn["role"] == perspective, F.lit("<|assistant|>"))
        .when(turn["role"] == SYSTEM, F.lit("<|system|>"))
        .otherwise(F.concat(F.lit("<|user name="), escaped_name(turn["role"]), F.lit("|>")))
    )
    return F.concat(head, F.lit("\n"), turn["text"], F.lit("\n"))


def mask(turns: Column, segments: Column, perspective: Column) -> Column:
    """Spans of the assistant's texts in the joined segments."""
    own = lambda ends: F.filter(
        F.transform(turns, lambda t, i: F.when(t["role"] == perspective, F.struct(
            (F.get(ends, i) - 1 - F.char_length(t["text"])).cast("int").alias("start"),
            (F.get(ends, i) - 1).cast("int").alias("end"),
        ))),
        lambda s: s.isNotNull(),
    )
    return let(prefix_sums(F.transform(segments, lambda s: F.char_length(s))), own)


def perspectives(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", turns_per_part: int | None = None) -> DataFrame:
    """(conv_id, perspective, part, n_turns, rendered, mask): one row per participant and part."""
    slim = turns.select(
        col(id).alias("conv_id"), col(turn).cast("bigint").alias("turn"),
        F.coalesce(col(role), F.lit(NOBODY)).alias("role"), escaped(F.coalesce(col(text), F.lit(""))).alias("text"),
    )
    cut = lambda n: F.floor(F.coalesce("turn", F.lit(-1)) / n).cast("bigint")
    whole = F.lit(0).cast("bigint") if turns_per_part is None else cut(turns_per_part)
    part = F.when(F.col("conv_id").isNull(), cut(LOOSE)).otherwise(whole)
    parts = slim.groupBy("conv_id", part.alias("part")).agg(
        F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns")
    )
    people = (
        slim.where(F.col("role") != SYSTEM).select("conv_id", "role").distinct()
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("role")).alias("people"))
        .withColumnRenamed("conv_id", "c")
    )
    people = sized_side(materialise(people, "participants"))
    rows = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    rows = rows.select("conv_id", "part", "turns", F.explode("people").alias("perspective"))
    rows = rows.withColumn("segments", F.transform("turns", lambda t: segment(t, F.col("perspective"))))
    return rows.select(
        "conv_id", "perspective", "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join("segments", "").alias("rendered"),
        mask(F.col("turns"), F.col("segments"), F.col("perspective")).alias("mask"),
    )
