"""License scans with a positional index of rare words.

Templates are phrases with a label; some words of a template are mandatory key phrases. One pass
counts in how many texts each template word stands. Each template is then indexed under its words
by place, and looked up by its rarest ones. In a text, every place of such a word gives alignments
(template, place of the template's first word); the postings of the template's other words are
intersected at the same relative places, and the mandatory phrases must stand there. All this
happens inside the row: nothing is moved but the word counts.

Base phrases are templates that are mandatory as a whole, so all their places are found: a place
needs its rarest word.

Defined cases: a null text is empty, has no words, no labels and score 0. Rows are judged one by
one, so repeated rows, null ids and foreign columns do no harm. An empty table counts nothing and
gives no rows; without counts, ties in rarity fall to the longer and then the earlier word.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import col

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A license text: its label, its words and the phrases of it that must stand in a file."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Base phrases and labels (fixed values).
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Notices and key sentences of well-known licenses (fixed texts).
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy",
             ("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify", "software for any purpose")),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("cc-by-sa", "creative commons attribution sharealike", ("attribution sharealike",)),
    Template("public-domain", "released into the public domain", ("public domain",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)
#: Share of the summed rarity of a template's words that an alignment must reach.
MIN_SHARE = 0.75
#: Rarest words by which a template is looked up.
ANCHORS = 3


def tokens(text: Column) -> Column:
    """Words of a text: ASCII letters and digits and all that is not ASCII, A-Z lower-cased.

    The Kelvin sign is the one character outside ASCII whose lower case is an ASCII letter by
    itself, so it is replaced by another letter outside ASCII before Spark's ``lower``.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.filter(F.split(plain, NOT_WORD), lambda w: w != "")


def word_counts(tokens_of: DataFrame, name: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of a fixed vocabulary stands; at most one number per word."""
    hit = F.array_distinct(F.filter(col(name), lambda w: w.isin(vocabulary)))
    rows = tokens_of.select(F.explode(hit).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


@dataclass(frozen=True)
class Index:
    """Postings of the templates: anchors by word, and each template's words with their rarity."""

    templates: tuple[Template, ...]
    anchors: dict[str, list[tuple[int, int]]]
    rarity: list[list[float]]

    @staticmethod
    def build(templates: tuple[Template, ...], counts: dict[str, int], n: int) -> Index:
        idf = lambda w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1
        anchors: dict[str, list[tuple[int, int]]] = {}
        rarity = []
        for t, template in enumerate(templates):
            ws = template.text.split()
            must = {w for k in template.keys for w in k.split()}
            ranked = sorted((w for w in dict.fromkeys(ws) if w in must), key=lambda w: (-idf(w), -len(w)))
            for w in ranked[: 1 if template.base else ANCHORS]:
                for at in (i for i, x in enumerate(ws) if x == w):
                    anchors.setdefault(w, []).append((t, at))
            rarity.append([idf(w) for w in ws])
        return Index(templates, anchors, rarity)


def _stand(words: Column, start: Column, phrase: list[str]) -> Column:
    """Whether the words of ``phrase`` stand consecutively from ``start`` on."""
    found = F.lit(True)
    for i, w in enumerate(phrase):
        found = found & F.coalesce(F.get(words, (start + i).cast("int")) == w, F.lit(False))
    return found


def alignments(words: Column, index: Index) -> Column:
    """Verified alignments of a text: array of (template, start, share), without repetition.

    A pair (template, start) travels as one number, so that repeated ones fall out by hashing.
    """
    anchor_words = list(index.anchors)
    many = len(index.templates)
    hits = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(anchor_words), F.struct(w.alias("w"), i.alias("i")))),
        lambda h: h.isNotNull(),
    )
    postings = F.create_map(*[
        x for w, at in index.anchors.items()
        for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in at]))
    ])
    codes = F.array_distinct(F.flatten(F.transform(
        hits,
        lambda h: F.transform(
            F.element_at(postings, h["w"]),
            lambda p: (h["i"] - p["p"]).cast("bigint") * many + p["t"],
        ),
    )))

    def checked(code: Column) -> Column:
        t = F.pmod(code, F.lit(many))
        start = F.floor(code / many)
        verdict = F.lit(None).cast("double")
        for k, template in enumerate(index.templates):
            ws, rare = template.text.split(), index.rarity[k]
            total = sum(rare)
            share = F.lit(0.0)
            for i, w in enumerate(ws):
                share = share + F.when(F.get(words, (start + i).cast("int")) == w, F.lit(rare[i])).otherwise(0.0)
            keys = F.lit(True)
            for phrase in template.keys:
                offset = next(i for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split())
                keys = keys & _stand(words, start + offset, phrase.split())
            verdict = F.when(
                t == k, F.when(keys & (share >= MIN_SHARE * total), F.round(share / total, 6))
            ).otherwise(verdict)
        return F.struct(t.cast("int").alias("t"), start.alias("start"), verdict.alias("share"))

    return F.filter(F.transform(codes, checked), lambda a: a["share"].isNotNull())


def license_table(
    docs: DataFrame, id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES
) -> DataFrame:
    """Per row: id, number of words, places of base phrases, their first and last start, base labels,
    all labels, the best share, and ``found``: (label, start, share) of every alignment."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    slim = docs.select(col(id).alias("doc_id"), tokens(col(text)).alias("words"))
    counts = word_counts(slim, "words", vocabulary)
    index = Index.build(templates, counts, max(docs.count(), 1))
    labels = F.array(*[F.lit(t.label) for t in templates])
    n_base = sum(t.base for t in templates)  # base templates stand first
    rows = slim.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.when(F.exists("words", lambda w: w.isin(list(index.anchors))), alignments(F.col("words"), index))
        .alias("hits"),
    )
    hits = F.coalesce(F.col("hits"), F.array().cast("array<struct<t:int,start:bigint,share:double>>"))
    rows = rows.select("doc_id", "n_words", hits.alias("hits"))
    base = F.filter("hits", lambda h: h["t"] < n_base)
    names = lambda found: F.array_join(
        F.array_sort(F.array_distinct(F.transform(found, lambda h: F.get(labels, h["t"])))), ","
    )
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
        F.transform("hits", lambda h: F.struct(
            F.get(labels, h["t"]).alias("label"), h["start"].alias("start"), h["share"].alias("share")
        )).alias("found"),
    )


def checked_templates(templates: tuple[Template, ...]) -> tuple[Template, ...]:
    """Templates as given, base first; every key phrase must be part of its text."""
    for t in templates:
        for k in t.keys:
            if not re.search(rf"(^| ){re.escape(k)}( |$)", t.text):
                raise ValueError(f"{k!r} is not part of {t.text!r}")
    return tuple(sorted(templates, key=lambda t: not t.base))


