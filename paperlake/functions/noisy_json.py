"""Strict JSON taken out of noisy responses, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import strip

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def unfence(text: Column) -> Column:
    """Text without code-fence marks, stripped."""
    return strip(F.regexp_replace(text, "```(?:json)?", ""))


def bracketed(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; empty text when there is none."""
    return F.regexp_extract(unfence(text), r"(?s)\[.*\]", 0)


def braced(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty text when there is none."""
    return F.regexp_extract(unfence(text), r"(?s)\{.*\}", 0)


def _in_object(text: Column) -> Column:
    return F.concat(F.lit('{"x":'), text, F.lit("}"))


def _is_one_value(text: Column) -> Column:
    # from_json ignores what follows the first value. Inside an object, a text that goes on
    # after its first value passes only with a "}" or another key there; inside an array, only
    # with a "]" or another element. Nothing but one whole value passes both.
    boxed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    return F.size(boxed) == 1


def strict_array(text: Column) -> Column:
    """Elements of a JSON array as texts; NULL when the text is not exactly one array."""
    parsed = F.from_json(_in_object(text), "x array<string>", _STRICT)["x"]
    return F.when(_is_one_value(text), parsed)


def object_flags(body: Column, texts: Column) -> Column:
    """For each element of the JSON array ``body``, whether it is an object.

    ``texts`` are the elements as :func:`strict_array` gives them. A *string* element that holds
    JSON looks like an object once its quotes are gone. Only a body with a quote before a brace
    can hold one; there the variant type decides, unless variant refuses the array because of
    repeated keys.
    """
    plain = F.transform(texts, lambda e: F.startswith(e, F.lit("{")))
    typed = F.transform(
        F.from_json(_in_object(body), "x array<variant>", _STRICT)["x"],
        lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")),
    )
    doubtful = body.rlike(r'"(\{|\\u007[bB])')
    return F.when(doubtful, F.coalesce(typed, plain)).otherwise(plain)


def object_elements(body: Column, texts: Column) -> Column:
    """(no, text) of the object elements; ``no`` is the place in the array.

    Elements that are not objects are left out.
    """
    marked = F.transform(
        F.arrays_zip(texts.alias("text"), object_flags(body, texts).alias("ok")),
        lambda e, i: F.struct(i.alias("no"), e["text"].alias("text"), e["ok"].alias("ok")),
    )
    return F.transform(
        F.filter(marked, lambda e: e["ok"]),
        lambda e: F.struct(e["no"].alias("no"), e["text"].alias("text")),
    )


def object_map(text: Column) -> Column:
    """Keys and values of a JSON object; a repeated key is still there as often as it occurs."""
    return F.from_json(text, "map<string,string>")


def query_list(text: Column) -> Column:
    """The ``queries`` list of the object inside a noisy response; NULL when there is none."""
    body = braced(text)
    found = F.from_json(_in_object(body), "x struct<queries: array<string>>", _STRICT)
    return F.when(_is_one_value(body), found["x"]["queries"])
