"""Paper-level functions: links, categories, authors, text blocks, prompts and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import WHITESPACE_CLASS, strip, text_window
from paperlake.functions.vocab import META_KEYS

# Host of the rendered preprint PDF for each source.
PREPRINT_HOSTS = {"bioRxiv": "www.biorxiv.org", "medRxiv": "www.medrxiv.org"}

#: Opening of a prompt for a run that brings no instruction of its own.
INSTRUCTION = (
    "Turn the paper at the end of this message into records.\n"
    "Reply with one JSON array and nothing around it. Each record is an object with the keys listed under Keys, "
    "spelled as they are there; a key whose value the paper leaves open gets null. A paper without any record gets []."
)


def last_match(items: Column) -> Column:
    """Last element of an array, or an empty string for an empty array."""
    return F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit(""))


def pdf_link(links: Column) -> Column:
    """Address of the last link that is titled ``pdf`` or has ``pdf`` in its address."""
    hits = F.filter(
        links,
        lambda k: (F.coalesce(k["title"], F.lit("")) == "pdf")
        | F.contains(F.coalesce(k["href"], F.lit("")), F.lit("pdf")),
    )
    return last_match(F.transform(hits, lambda k: F.coalesce(k["href"], F.lit(""))))


def doi_link(links: Column) -> Column:
    """Last link address that contains ``doi.org``."""
    hrefs = F.transform(links, lambda k: F.coalesce(k["href"], F.lit("")))
    return last_match(F.filter(hrefs, lambda h: F.contains(h, F.lit("doi.org"))))


def category_list(primary: Column, others: Column) -> Column:
    """Primary terms first, then the other non-empty terms not yet present."""
    shown = F.filter(primary, lambda t: F.coalesce(t, F.lit("")) != "")
    rest = F.filter(
        F.array_distinct(others),
        lambda t: (F.coalesce(t, F.lit("")) != "") & ~F.array_contains(shown, t),
    )
    return F.concat(shown, rest)


def author_list(names: Column) -> Column:
    """Non-empty names, stripped."""
    return F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), strip)


def text_block(
    title: Column, authors: Column, date: Column, doi: Column, categories: Column,
    abstract: Column, category_label: str = "CATEGORIES",
) -> Column:
    """The labelled text of a paper, one label per line."""
    parts = [
        ("TITLE", title), ("AUTHORS", authors), ("DATE", date), ("DOI", doi),
        (category_label, categories), ("ABSTRACT", abstract),
    ]
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in parts]
    )


def doi_url(doi: Column) -> Column:
    """Resolver address of a DOI; empty for an empty DOI."""
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.lit(""))


def preprint_pdf_url(doi: Column, version: Column, source: Column) -> Column:
    """Full-text address on the host of the paper's own source."""
    host = F.lit(PREPRINT_HOSTS["bioRxiv"])
    for name, address in PREPRINT_HOSTS.items():
        host = F.when(source == name, F.lit(address)).otherwise(host)
    url = F.concat(F.lit("https://"), host, F.lit("/content/"), doi, F.lit("v"), version,
                   F.lit(".full.pdf"))
    return F.when(doi != "", url).otherwise(F.lit(""))


def render_prompt(
    fields: Column, text: Column, instruct: Column | None = None, window: int | None = None,
    issues: Column | None = None,
) -> Column:
    """Instruction, what an earlier reply lacked, keys, and the paper between two marks.

    The text is shown whole unless a window is given.
    """
    head = F.lit(INSTRUCTION) if instruct is None else instruct
    lacks = F.lit("") if issues is None else F.when(
        F.size(issues) > 0, F.concat(F.lit("\nThe last reply fell short: "), F.array_join(issues, "; "))
    ).otherwise("")
    return F.concat(
        head, lacks, F.lit("\nKeys: "), F.array_join(fields, " | "),
        F.lit("\n<paper>\n"), text_window(text, window), F.lit("\n</paper>"),
    )


def meta_map(meta: Column) -> Column:
    """All metadata of a paper as a map, absent values as empty strings."""
    pairs = [p for k in META_KEYS for p in (F.lit(k), F.coalesce(meta[k], F.lit("")))]
    return F.create_map(*pairs)


def filled_meta(meta: Column) -> Column:
    """Metadata map without empty values."""
    return F.map_filter(meta_map(meta), lambda _, v: v != "")


# Java's dot also stops at \r and U+2028 unless told otherwise; (?d) leaves \n alone.
_ABSTRACT = rf"(?s)ABSTRACT:[{WHITESPACE_CLASS}]*(.+)"
_JOURNAL = rf"(?d)JOURNAL:[{WHITESPACE_CLASS}]*(.+)"


def _labelled(text: Column, pattern: str) -> Column:
    # regexp_extract gives '' for "no match"; NULL tells absent from blank.
    return F.when(
        F.regexp_like(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, 1))
    )


def abstract_of(text: Column) -> Column:
    """Everything after the ``ABSTRACT:`` label; NULL when there is no such label."""
    return _labelled(text, _ABSTRACT)


def journal_of(text: Column) -> Column:
    """The line after the ``JOURNAL:`` label; NULL when there is no such label."""
    return _labelled(text, _JOURNAL)
