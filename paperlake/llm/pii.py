"""Personal data: patterns of known form, and bootstrapped contextual extraction.

Four kinds are found by their form. They are the seeds: every identifier-like run of a text (one that holds
three digits or more, or an at sign) is an instance, the one or two words before it are its lexical patterns, and an
instance that a seed covers is known. Patterns and instances form a graph, whose edges are counted once
however many copies of a text there are. In each round a pattern is trusted for a kind if enough of its
instances are known to be of this kind, and the unknown instances of trusted patterns become known.
The rounds end when one adds nothing; then the places of the newly known instances are reported as ``ctx_<kind>``.

Everything per text happens in the row; the graph is joined and aggregated by Spark, and the places of discovered
instances return to the texts by a hash of the text, so copies share them.

Defined cases: a null text is empty and has no spans. Rows with the same text get the same spans,
whatever their ids. An empty table gives no rows. Foreign columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import SPANS, col, joined_spans, let, spans, tagged
from paperlake.session import materialise, sized_side

#: A run of local-part characters has one possible address end, so only its start (or the end of the
#: match before) needs to be tried; likewise for digits. Possessive repeats keep all of them linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_FORM = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
RUN = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
KINDS = ("email", "ip", "card", "phone")
#: Digits an instance must hold; known instances a trusted pattern needs, and their least share.
MIN_DIGITS, MIN_KNOWN, MIN_SHARE = 3, 4, 0.75
#: Rounds after which the tables of known instances are written as one.
MERGE_ROUNDS = 8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check; 13 to 19 digits."""

    def total(d: Column) -> Column:
        size = F.char_length(d)

        def add(acc: Column, i: Column) -> Column:
            n = F.substring(d, size - i, F.lit(1)).cast("int") * (i % 2 + 1)
            return acc + n % 10 + F.floor(n / 10).cast("int")

        ok = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0
        return F.when((size >= 13) & (size <= 19), ok).otherwise(F.lit(False))

    return let(_digits(value), total)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four base kinds. A cheap test of the text comes before each search."""
    empty = F.array().cast(SPANS)
    only = lambda gate, found: F.when(gate, found).otherwise(empty)
    n_digits = lambda v: F.char_length(_digits(v))
    return {
        "email": only(F.contains(text, F.lit("@")), spans(text, EMAIL)),
        "ip": only(text.rlike(r"[0-9]\.[0-9]"), spans(text, IP, lambda v: v.rlike(IP_FORM))),
        "card": only(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), spans(text, CARD, luhn)),
        "phone": only(text.rlike(r"\+[0-9]"), spans(text, PHONE, lambda v: n_digits(v).between(9, 15))),
    }


def _patterns(left: Column) -> Column:
    """Lexical patterns from the text before an instance: its last two words, and its last one.

    The text is read backwards, so that only its end is looked at, however long it or a word is.
    """
    tail = F.regexp_extract(F.reverse(left), r"^\s++(\S++(?:\s++\S++)?+)", 1)

    def of(plain: Column) -> Column:
        both = F.array(
            F.concat(F.lit("2:"), F.regexp_extract(plain, r"^(\S++ \S++)$", 1)),
            F.concat(F.lit("1:"), F.element_at(F.split(plain, " "), -1)),
        )
        return F.filter(both, lambda p: F.length(p) > 2)

    return let(F.regexp_replace(F.regexp_replace(F.lower(F.reverse(tail)), "[0-9]+", "0"), r"\s+", " "), of)


def found(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, key, base, runs): base spans by kind, and identifier-like runs with their patterns and
    the kind of the base span that covers them. Texts are read once and not kept."""
    t = F.coalesce(col(text), F.lit(""))
    slim = docs.select(col(id).alias("doc_id"), t.alias("text"))
    per_kind = base_spans(F.col("text"))
    rows = slim.select(
        "doc_id", F.md5("text").alias("key"),
        *[found.alias(k) for k, found in per_kind.items()],
        F.when(
            F.col("text").rlike("[0-9@]"),
            spans(F.col("text"), RUN, lambda v: (F.char_length(_digits(v)) >= MIN_DIGITS) | F.contains(v, F.lit("@")),
                  left=None),
        ).otherwise(F.array().cast(SPANS)).alias("runs"),
    )
    base = F.concat(*[tagged(F.col(k), k, i) for i, k in enumerate(KINDS)])
    rows = rows.select("doc_id", "key", base.alias("base"), "runs")
    kind_of = lambda r: F.get(
        F.filter("base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])), F.lit(0)
    )["kind"]
    runs = F.transform("runs", lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), F.lower(r["value"]).alias("instance"),
        _patterns(r["left"]).alias("patterns"), kind_of(r).alias("kind"),
    ))
    return rows.select("doc_id", "key", "base", runs.alias("runs"))


def discovered(rows: DataFrame) -> DataFrame:
    """(instance, kind): unseen instances that trusted patterns discover. Each round but the last makes some instance
    known, so the rounds end."""
    edges = materialise(
        rows.select(F.explode("runs").alias("r"))
        .select(F.col("r.instance").alias("instance"), F.explode("r.patterns").alias("pattern"),
                F.col("r.kind").alias("kind"))
        .groupBy("pattern", "instance").agg(F.min("kind").alias("seed")),
        "pii-edges",
    )
    known = materialise(
        edges.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind"))
        .withColumn("round", F.lit(0)), "pii-known",
    )
    for n in itertools.count(1):
        judged = edges.join(known.select("instance", "kind"), "instance", "left")
        per_kind = judged.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        best = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
        trusted = (
            per_kind.groupBy("pattern").agg(best.alias("best"), F.sum("n").alias("all"))
            .where((F.col("best.n") >= MIN_KNOWN) & (F.col("best.n") >= F.col("all") * MIN_SHARE))
            .select("pattern", F.col("best.kind").alias("kind"),
                    (F.col("best.n") / F.col("all") * F.log2(F.col("best.n") + 1)).alias("score"))
        )
        trusted = materialise(trusted, "pii-patterns")
        new = (
            edges.join(sized_side(trusted), "pattern")
            .groupBy("instance", "kind").agg(F.sum("score").alias("score"))
            .join(known.select("instance"), "instance", "left_anti")
            .groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
            .withColumn("round", F.lit(n))
        )
        new = materialise(new, "pii-new")
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if n % MERGE_ROUNDS == 0:
            known = materialise(known, "pii-known")
    return known.where("round > 0").select("instance", "kind")


def pii_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``all``: arrays of (order, start, end, kind), in this order."""
    rows = materialise(found(docs, id, text), "pii-rows")
    new = discovered(rows).select("instance", F.col("kind").alias("new_kind"))
    order = F.lit(len(KINDS)) + F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("new_kind"))
    places = (
        rows.select("key", F.explode("runs").alias("r")).where("r.kind is null")
        .select("key", F.col("r.instance").alias("instance"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
        .join(sized_side(new), "instance")
        .select("key", F.struct(
            order.cast("int").alias("order"), "start", "end", F.concat(F.lit("ctx_"), "new_kind").alias("kind")
        ).alias("span"))
        .distinct().groupBy("key").agg(F.collect_list("span").alias("more"))
    )
    none = F.array().cast("array<struct<order:int,start:int,end:int,kind:string>>")
    joined = rows.select("doc_id", "key", "base").join(materialise(places, "pii-places"), "key", "left")
    return joined.select(
        "doc_id", F.sort_array("base").alias("base"),
        F.sort_array(F.concat("base", F.coalesce("more", none))).alias("all"),
    )


def pii_digest(table: DataFrame) -> DataFrame:
    """The digest columns of ``pii_table``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return table.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("all")).alias("spans"),
    )
