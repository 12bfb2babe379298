"""Text functions: tokens, keywords, whitespace, dates and key names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.vocab import LIFE_SCIENCE_STEMS, STOP_WORDS

# Every character Unicode and the record formats treat as white space.
WHITESPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE = "".join(
    chr(c)
    for first, last in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(first, last + 1)
)


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind (``trim`` knows blanks only)."""
    return F.trim(text, F.lit(WHITESPACE))


def split_words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.filter(
        F.split(text, f"[{WHITESPACE_CLASS}]+"), lambda w: w != ""
    )


def collapse(text: Column) -> Column:
    """Stripped text in which every run of white space is one blank."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE_CLASS}]+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII alphanumeric tokens, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(text: Column) -> Column:
    """Tokens that are neither stop words nor single characters."""
    return F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def filter_words(text: Column) -> Column:
    """Keywords, or the lower-cased words longer than two characters when there are none."""
    found = keywords(text)
    spare = F.transform(F.filter(split_words(text), lambda w: F.length(w) > 2), F.lower)
    return F.when(F.size(found) > 0, found).otherwise(spare)


def is_life_science(text: Column) -> Column:
    """True when any life-science stem occurs anywhere in the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in LIFE_SCIENCE_STEMS])


def expand_queries(prompt: Column) -> Column:
    """Three search queries made from the first six words longer than three characters."""
    words = F.slice(F.filter(split_words(prompt), lambda w: F.length(w) > 3), 1, 6)
    return F.array(
        F.array_join(F.slice(words, 1, 4), " "),
        F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit(" recent")),
        F.array_join(F.slice(words, 2, 4), " "),
    )


def date_prefix(published: Column) -> Column:
    """First ten characters of a date text (the whole text when shorter)."""
    return F.substring(published, 1, 10)


def text_window(text: Column, size: int | None = 4000) -> Column:
    """The part of a text shown to a responder; ``None`` shows the whole text."""
    return text if size is None else F.substring(text, 1, size)


def key_name(key: Column) -> Column:
    """Normalised key: stripped, lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(strip(key)), " -", "__")


def title_key(title: Column) -> Column:
    """Key under which two titles are the same."""
    return strip(F.lower(title))


def doi_norm(doi: Column) -> Column:
    """DOI without resolver address, lower case; empty when the text is not a DOI."""
    bare = F.regexp_replace(F.lower(strip(doi)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(bare.rlike(r"^10\.\d+/.+"), bare).otherwise(F.lit(""))
