"""Quality rules with adaptive thresholds.

Every text gives a few counts. Integer rates of the texts that pass the fixed base rules go into
mergeable quantile sketches, one per language, source and rate: histograms with log-linear buckets
(32 per power of two, so a quantile is off by 1/32 at most), which merge by adding counts and give
the same answer in any order. Quartiles of the sketches set the limits of each language and source;
small groups take the sketch of their language, or of everything, which is the merge of theirs. The
limits are then joined to the rows.

Defined cases: a null or empty text has no words and fails the base rules. Null languages and
sources are groups of their own. Repeated rows count and are judged one by one. An empty table
gives no sketch and no rows. Columns of any other name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import GAP, col, fresh, let, words
from paperlake.session import materialise, sized_side

#: Base rules: fewest words, largest percentage of words in repeated windows, window length.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Rates: name -> (least distance of the upper limit from the quartile, that of the lower one).
RATES = {"symbols": (40, None), "dup_lines": (400, None), "repeats": (250, None), "word_len": (120, 200)}
#: Interquartile ranges between a quartile and its limit; fewest texts of a group's own sketch.
FENCE, MIN_GROUP = 4, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash stands twice or more. Equal hashes are neighbours once
    sorted; the places of their windows, sorted again, cover min(8, distance to the next)."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(
        ordered,
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))
                    | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
                ),
                lambda e: e["i"],
            )
        ),
    )
    covered = let(
        twice,
        lambda at: F.transform(
            at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
        ),
    )
    return F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, n: a + n)


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the five counts and ``n_lines``, under free names: count -> column."""
    wide = fresh(docs, "words", "hashes", "lines", *COUNTS, "n_lines")
    w, h, lines, *counts = wide
    name = dict(zip([*COUNTS, "n_lines"], counts, strict=True))
    t = F.coalesce(col(text), F.lit(""))
    keep = [col(c) for c in docs.columns]
    size = F.size(w)
    windows = F.when(
        size >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), size - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(col(w), i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    out = docs.select(*keep, words(col(text)).alias(w))
    out = out.select(
        *keep, w, windows.alias(h),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    # A filter on the counts would be pushed below the projections and compute them many times over;
    # it is not pushed below a generator.
    found = F.struct(
        F.size(w).cast("bigint").alias(name["n_words"]),
        (F.char_length(t) - F.regexp_count(t, F.lit(GAP))).cast("bigint").alias(name["word_chars"]),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias(name["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias(name["n_dup_lines"]),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated_words(col(h)))
        .otherwise(F.lit(0)).cast("bigint").alias(name["n_repeat_words"]),
        F.size(lines).cast("bigint").alias(name["n_lines"]),
    )
    return out.select(*keep, F.inline(F.array(found))), name


def base_failed(name: dict[str, str]) -> Column:
    n, repeated = col(name["n_words"]), col(name["n_repeat_words"])
    return (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PERCENT)


def rates(name: dict[str, str]) -> dict[str, Column]:
    """Integer rates, in thousandths; word length in hundredths of a character."""
    n, chars, symbols, dup, repeated = (col(name[c]) for c in COUNTS)
    per = lambda a, b: F.floor(a / F.greatest(b, F.lit(1)))
    return {
        "symbols": per(symbols * 1000, chars),
        "dup_lines": per(dup * 1000, col(name["n_lines"])),
        "repeats": per(repeated * 1000, n),
        "word_len": per(chars * 100, n),
    }


def group_key(value: Column) -> Column:
    """A key that tells null from any text."""
    return F.coalesce(F.concat(F.lit("v"), value), F.lit("n"))


def bucket(value: Column) -> Column:
    """Lower edge of the log-linear bucket of a count: its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("bigint")
    return F.floor(value / step) * step


def sketches(counted: DataFrame, name: dict[str, str], lang: str, source: str) -> DataFrame:
    """(lang, source, rate, bucket, n): the sketches of all groups, a table of bounded rows per group."""
    per_row = F.array(
        *[F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in rates(name).items()]
    )
    return (
        counted.where(~base_failed(name))
        .select(group_key(col(lang)).alias("lang"), group_key(col(source)).alias("source"),
                F.explode(per_row).alias("r"))
        .groupBy("lang", "source", "r.rate", "r.bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: number of texts and the quartiles of each rate, as lower bucket edges."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "rate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys, "rate"))
    )
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("n"), at(25).alias("low"), at(75).alias("high")
    )


def limits(sketch: DataFrame) -> DataFrame:
    """One row per language and source: ``<rate>_max`` and ``<rate>_min``."""
    own = _quartiles(sketch, ["lang", "source"])
    of_lang = _quartiles(sketch, ["lang"]).select(
        "lang", "rate", F.col("n").alias("n2"), F.col("low").alias("low2"), F.col("high").alias("high2")
    )
    of_all = _quartiles(sketch, []).select("rate", F.col("low").alias("low3"), F.col("high").alias("high3"))
    both = own.join(of_lang, ["lang", "rate"]).join(of_all, ["rate"])
    pick = lambda c: F.when(F.col("n") >= MIN_GROUP, F.col(c)).when(
        F.col("n2") >= MIN_GROUP, F.col(c + "2")
    ).otherwise(F.col(c + "3"))
    both = both.select("lang", "source", "rate", pick("low").alias("low"), pick("high").alias("high"))
    spread = (F.col("high") - F.col("low")) * FENCE
    sides = []
    for rate, (above, below) in RATES.items():
        is_rate = F.col("rate") == rate
        sides.append(F.max(F.when(is_rate, F.col("high") + F.greatest(spread, F.lit(above)))).alias(f"{rate}_max"))
        if below is not None:
            sides.append(F.max(F.when(is_rate, F.col("low") - F.greatest(spread, F.lit(below)))).alias(f"{rate}_min"))
    return both.groupBy("lang", "source").agg(*sides)


def learned_limits(counted: DataFrame, name: dict[str, str], lang: str, source: str) -> DataFrame:
    sketch = materialise(sketches(counted, name, lang, source), "quality-sketch")
    return materialise(limits(sketch), "quality-limits")


def judged(
    counted: DataFrame, name: dict[str, str], table: DataFrame, lang: str, source: str, kept: str
) -> DataFrame:
    """``counted`` with the verdict: the limits join on language and source, as a broadcast while
    their measured size allows and as a merge join beyond."""
    lkey, skey = fresh(counted, "lang_key", "source_key")
    cut = {c: f"__limit_{c}" for c in table.columns}
    table = table.select(*[F.col(c).alias(cut[c]) for c in table.columns])
    rows = counted.withColumns({lkey: group_key(col(lang)), skey: group_key(col(source))})
    joined = rows.join(
        sized_side(table), (col(lkey) == F.col(cut["lang"])) & (col(skey) == F.col(cut["source"])), "left"
    )
    fine = ~base_failed(name)
    for rate, value in rates(name).items():
        fine = fine & F.coalesce(value <= F.col(cut[f"{rate}_max"]), F.lit(True))
        if RATES[rate][1] is not None:
            fine = fine & F.coalesce(value >= F.col(cut[f"{rate}_min"]), F.lit(True))
    return joined.withColumn(kept, fine).drop(lkey, skey, *cut.values())


def quality_table(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """Id, the five counts, ``base_failed`` and ``kept`` of every row. Texts are read once."""
    slim = docs.select(col(id).alias("doc_id"), col(lang).alias("lang"), col(source).alias("source"),
                       col(text).alias("text"))
    counted, name = with_counts(slim)
    counted = materialise(counted.drop("text"), "quality-counts")
    table = learned_limits(counted, name, "lang", "source")
    out = judged(counted, name, table, "lang", "source", "kept")
    return out.select(
        "doc_id", *[col(name[c]).alias(c) for c in COUNTS], base_failed(name).alias("base_failed"), "kept"
    )


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. One pass learns the limits, a second
    one applies them, so no text is written or moved."""
    counted, name = with_counts(docs, text)
    table = learned_limits(counted, name, lang, source)
    (kept,) = fresh(counted, "kept")
    out = judged(counted, name, table, lang, source, kept)
    return out.where(col(kept)).select(*[col(c) for c in docs.columns])
