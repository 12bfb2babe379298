"""Mixing sources to target weights by Poisson replication.

A source with target share w of N wanted characters, and c characters of its own, repeats at the
mean rate w N / c. Each document draws its number of copies from the Poisson distribution of that
mean: a hash of seed and document gives a uniform number, which the inverse of the distribution
function turns into a count. Sums of Poisson numbers are Poisson numbers, so a mean above 16 is split
into equal parts, each with a draw of its own; tables of the distribution function stay short. The
copies are exploded and dealt over all partitions by a hash of (seed, document, copy), and sorted
by it within each.

Defined cases: the draw depends on the id and, so that repeated ids differ, on the text; identical
rows draw the same count. Null sources are a source of their own. A source without characters has
rate 0 and drops out, unless its weight asks for nothing else: nothing can be repeated from it.
Sources that the given weights do not name have weight 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import col, fresh, let
from paperlake.llm.quality import group_key
from paperlake.session import materialise, sized_side

#: Exponent of the source sizes where no weights are given: 1 keeps the mix, 0 makes it even.
TEMPERATURE = 0.7
#: Largest mean of one draw, and terms of its distribution function (their rest is below 1e-16).
PART, TERMS = 16.0, 80


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 hash."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a mean of at most 16."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("steps"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        return let(
            F.struct(term.alias("term"), (acc["total"] + term).alias("total")),
            lambda n: F.struct(
                n["term"].alias("term"), n["total"].alias("total"),
                F.concat(acc["steps"], F.array(n["total"])).alias("steps"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda a: a["steps"])


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None, epochs: float,
                 text: str, source: str) -> DataFrame:
    """One row per source: key, characters, target share, mean rate, parts, distribution steps."""
    sizes = docs.groupBy(group_key(col(source)).alias("key")).agg(
        F.sum(F.char_length(F.coalesce(col(text), F.lit("")))).alias("chars")
    )
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            key = "n" if name is None else "v" + name
            weight = F.when(F.col("key") == key, F.lit(float(w))).otherwise(weight)
    sizes = materialise(sizes.select("key", "chars", weight.alias("weight")), "mix-sizes")
    all_chars, all_weight = sizes.agg(F.sum("chars"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(all_weight)) if all_weight else F.lit(0.0)
    rate = share * F.lit(float((all_chars or 0) * epochs)) / F.col("chars")
    rated = sizes.select(
        "key", "chars", share.alias("share"),
        F.when(F.col("chars") > 0, rate).otherwise(0.0).alias("rate"),
    )
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    return rated.withColumn("parts", parts).withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))


def with_copies(docs: DataFrame, rates: DataFrame, seed: int, id: str, text: str, source: str,
                name: str) -> DataFrame:
    """``docs`` with the number of copies of each row."""
    key, tag = fresh(docs, "mix_key", "mix_tag")
    rates = rates.select(*[F.col(c).alias(f"__rate_{c}") for c in ("key", "parts", "steps")])
    doc = F.concat_ws(":", F.coalesce(col(id).cast("string"), F.lit("null")),
                      F.md5(F.coalesce(col(text), F.lit(""))))
    joined = docs.withColumns({key: group_key(col(source)), tag: doc}).join(
        sized_side(rates), col(key) == F.col("__rate_key"), "left"
    )

    def draw(part: Column) -> Column:
        return let(
            uniform(F.lit(str(seed)), col(tag), part.cast("string")),
            lambda u: F.size(F.filter(F.col("__rate_steps"), lambda s: s <= u)),
        )

    count = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("__rate_parts")), draw), F.lit(0), lambda a, n: a + n
    )
    return joined.withColumn(name, F.coalesce(count, F.lit(0))).drop(key, tag, *rates.columns)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: int = 7,
        id: str = "doc_id", text: str = "text", source: str = "source", copy: str | None = "copy_no",
        shuffle: bool = True) -> DataFrame:
    """Replicated and globally shuffled rows of ``docs``, with the number of the copy (from 0)
    under the name ``copy`` (none: left out)."""
    rates = materialise(source_rates(docs, weights, epochs, text, source), "mix-rates")
    count, number, place = fresh(docs, "mix_count", "mix_no", "mix_place")
    counted = with_copies(docs, rates, seed, id, text, source, count).where(col(count) > 0)
    rows = counted.select(
        *[col(c) for c in docs.columns],
        F.explode(F.sequence(F.lit(0), col(count) - 1)).alias(number),
    )
    if shuffle:
        key = F.xxhash64(F.lit(seed), col(id), F.coalesce(col(text), F.lit("")), col(number))
        rows = rows.withColumn(place, key).repartition(col(place)).sortWithinPartitions(col(place)).drop(place)
    if copy is None:
        return rows.drop(number)
    if copy.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {copy!r} already; give another name for the copy number")
    return rows.withColumnRenamed(number, copy)
