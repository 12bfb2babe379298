"""Saved searches matched against a corpus.

No operator here compares every search with every paper. Token strategies are an equi-join of
search keywords with the inverted index of the corpus; substring tests go through the
corpus in one pass with an automaton of all needles, or, if they are too many to hand to every task, through the
vocabulary, whose words are joined on the first letters of what is looked for. Only ids travel
through the shuffles, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import keywords, split_words, strip, tokens
from paperlake.operators.queries import filter_keywords, query_keywords
from paperlake.operators.rows import one_row_each
from paperlake.session import materialise, sized_side

TITLE, ABSTRACT = 1, 2
STRICT, SHORT, BROAD, TITLE_ONLY, PHRASE = 1, 2, 3, 4, 5


# --------------------------------------------------------------------------- indexes
def token_index(corpus: DataFrame) -> DataFrame:
    """(paper_id, token, place): distinct tokens of title and abstract."""

    def placed(text: str, place: int) -> Column:
        return F.transform(
            F.array_distinct(tokens(F.col(text))),
            lambda w: F.struct(w.alias("token"), F.lit(place).alias("place")),
        )

    both = F.concat(placed("title", TITLE), placed("abstract", ABSTRACT))
    return one_row_each(corpus, ["paper_id"], both, "_t").select("paper_id", "_t.*")


def lower_texts(corpus: DataFrame, *more: str) -> DataFrame:
    """(paper_id, title, abstract, more), the texts stripped and in lower case."""
    return corpus.select("paper_id", *[F.lower(strip(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in ("title", "abstract")], *more)


def word_index(texts: DataFrame) -> DataFrame:
    """(paper_id, word): distinct whitespace-separated words of :func:`lower_texts`."""
    text = F.concat_ws(" ", "title", "abstract")
    return one_row_each(texts, ["paper_id"], F.array_distinct(split_words(text)), "word")


# --------------------------------------------------------------------------- token strategies
def keyword_hits(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Which keyword positions of a query occur in title and abstract of a paper, as bit masks."""
    return places(index.join(sized_side(query_keywords(queries)), F.col("token") == F.col("keyword")), "paper_id")


def places(found: DataFrame, *keys: str) -> DataFrame:
    """Postings of a query's keywords folded into two bit masks per query and ``keys``."""
    here = lambda place: F.bit_or(
        F.when(F.col("place") == place, F.col("mask")).otherwise(0)
    )
    return found.groupBy("run_id", "query_no", "n_keywords", *keys).agg(
        here(TITLE).alias("in_title"), here(ABSTRACT).alias("in_abstract")
    )


def paper_hits(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """:func:`keyword_hits` of a corpus. A paper's keywords are looked up where it is read, so no posting is shuffled; only papers
    whose id stands in several rows, and searches too many for every task, go through the token index."""
    asked = materialise(query_keywords(queries), "asked")
    if (asked.agg(F.sum(F.octet_length("keyword") + 64)).first()[0] or 0) > NEEDLE_BYTES:
        return keyword_hits(queries, token_index(corpus))
    single, copies = _by_copies(corpus)
    found = _looked_up(single, asked)
    return found if copies is None else found.unionByName(keyword_hits(queries, token_index(copies)).select(*found.columns))


def _looked_up(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """Keyword positions in title and abstract of each paper row by itself, from one pass over the tokens."""
    given = {c: asked.schema[c].dataType.simpleString() for c in ("run_id", "query_no", "n_keywords")}
    paper = f"paper_id {corpus.schema['paper_id'].dataType.simpleString()}"
    schema = ", ".join([*(f"{c} {t}" for c, t in given.items()), paper, "in_title int", "in_abstract int"])
    wanted = asked.select(*given, "keyword", "mask").collect()
    if not wanted:
        return corpus.sparkSession.createDataFrame([], schema)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {key: n for n, key in enumerate(dict.fromkeys(tuple(r)[:3] for r in wanted))}
        types = {"int": pa.int32(), "bigint": pa.int64()}
        keys = [pa.array(column, types.get(t)) for column, t in zip(zip(*number, strict=True), given.values(), strict=True)]
        words = list(dict.fromkeys(r["keyword"] for r in wanted))
        place = {w: n for n, w in enumerate(words)}
        by_word = sorted((place[r["keyword"]], number[tuple(r)[:3]], r["mask"]) for r in wanted)
        word, query, mask = (np.array(column, np.int64) for column in zip(*by_word, strict=True))
        starts = np.searchsorted(word, np.arange(len(words) + 1))
        vocabulary = pa.array(words)

        def hits(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Row and query as one number, ascending, and the mask of the query's keywords in that row."""
            row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
            at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            row, at = np.divmod(np.unique(row[at >= 0] * len(words) + at[at >= 0]), len(words))
            times = starts[at + 1] - starts[at]
            entry = np.arange(times.sum()) + np.repeat(starts[at] - np.cumsum(times) + times, times)
            key = np.repeat(row, times) * len(number) + query[entry]
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            return key, np.bitwise_or.reduceat(mask[entry[order]], first) if len(first) else first

        for batch in batches:
            for s in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(s, COUNTED_ROWS)
                placed = [hits(part.column(c)) for c in ("title", "abstract")]
                every = np.union1d(placed[0][0], placed[1][0])
                masks = []
                for key, folded in placed:
                    masks.append(np.zeros(len(every), np.int32))
                    masks[-1][np.searchsorted(every, key)] = folded
                row, which = np.divmod(every, len(number))
                yield pa.RecordBatch.from_arrays(
                    [*(k.take(pa.array(which)) for k in keys), part.column("paper_id").take(pa.array(row)), *map(pa.array, masks)],
                    [*given, "paper_id", "in_title", "in_abstract"])

    whole = F.col("title").isNotNull() & F.col("abstract").isNotNull()  # as in the token index, others have no tokens
    shown = [F.when(whole, tokens(F.col(c))).otherwise(F.array().cast("array<string>")).alias(c) for c in ("title", "abstract")]
    return corpus.select("paper_id", *shown).mapInArrow(look_up, schema)


def strategy_hits(hits: DataFrame, *more: str) -> DataFrame:
    """(run_id, query_no, strategy_no, paper_id, matched, more) for the four keyword strategies.

    1 all of the first five keywords, each in title or abstract; 2 the same for the first
    three, given at least three; 3 any of the first six in the abstract; 4 all of the first
    three in the title.
    """
    title, abstract = F.col("in_title"), F.col("in_abstract")
    either = title.bitwiseOR(abstract)
    n = F.col("n_keywords")

    def first(k: int) -> Column:
        return F.expr(f"shiftleft(1, least(n_keywords, {k})) - 1")

    def has_all(mask: Column, k: int) -> Column:
        return mask.bitwiseAND(first(k)) == first(k)

    def found(no: int, test: Column, mask: Column, k: int) -> Column:
        count = F.bit_count(mask.bitwiseAND(first(k))).cast("int")
        return F.when(test, F.struct(F.lit(no).alias("strategy_no"), count.alias("matched")))

    ways = F.array(
        found(STRICT, has_all(either, 5), either, 5),
        found(SHORT, (n >= 3) & has_all(either, 3), either, 3),
        found(BROAD, abstract.bitwiseAND(first(6)) != 0, abstract, 6),
        found(TITLE_ONLY, has_all(title, 3), title, 3),
    )
    keep = ["run_id", "query_no", "paper_id", *more]
    return one_row_each(hits, keep, ways, "_way").select(*keep, "_way.*")


# --------------------------------------------------------------------------- substrings
def _grams(word: Column) -> Column:
    """All substrings of one, two and three characters (a look-ahead keeps this linear)."""
    of_length = lambda k: F.regexp_extract_all(
        word, F.lit("(?s)(?=(.{%d}))" % k), F.lit(1)
    )
    return F.array_distinct(F.concat(of_length(1), of_length(2), of_length(3)))


def numbered_needles(needles: DataFrame) -> DataFrame:
    """(needle, needle_id): distinct needles under short unique numbers."""
    return materialise(
        needles.select("needle").distinct().withColumn("needle_id", F.monotonically_increasing_id()),
        "needles",
    )


def contained_in(words: DataFrame, needles: DataFrame) -> DataFrame:
    """(word, needle_id) for every needle that is a substring of a word.

    ``words`` are distinct and ``needles`` numbered. A needle can only lie in words that hold
    its first three characters, so words meet needles on those and the test itself settles it.
    """
    heads = needles.withColumn("_gram", F.left(F.col("needle"), F.lit(3)))
    return (
        one_row_each(words, ["word"], _grams(F.col("word")), "_gram")
        .join(sized_side(heads), "_gram")
        .where(F.contains(F.col("word"), F.col("needle")))
        .select("word", "needle_id")
    )


#: Most bytes of needles that every task gets as one automaton; beyond, needles meet the vocabulary in a join.
NEEDLE_BYTES = 16 << 20
#: Papers whose counts make one batch of rows.
COUNTED_ROWS = 256


def _handed_out(needles: DataFrame) -> list[tuple[str, int]] | None:
    """The needles, if their measured size allows every task to hold them."""
    size = needles.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0
    return [tuple(r) for r in needles.select("needle", "needle_id").collect()] if size <= NEEDLE_BYTES else None


def scanned(texts: DataFrame, needles: list[tuple[str, int]]) -> DataFrame:
    """(paper_id, needle_id): needles that occur in title or abstract, each once per paper, from one pass over the texts."""
    schema = f"paper_id {texts.schema['paper_id'].dataType.simpleString()}, needle_id bigint"
    if not needles:
        return texts.sparkSession.createDataFrame([], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle, number in needles:
            automaton.add_word(needle, number)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, (title, abstract) in enumerate(zip(batch.column("title"), batch.column("abstract"), strict=True)):
                hits = {n for text in (title.as_py(), abstract.as_py()) for _, n in automaton.iter(text)}
                rows += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays(
                [batch.column("paper_id").take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], ["paper_id", "needle_id"]
            )

    return texts.select("paper_id", "title", "abstract").mapInArrow(scan, schema)


def substring_papers(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(paper_id, needle_id) for every whitespace-free needle that occurs in a paper.

    Needles that are too many for an automaton go through the vocabulary: one without white space lies within one word, so it is
    enough to find the words that contain it; papers follow by equality of words.
    """
    small = _handed_out(needles)
    if small is not None:
        return scanned(texts, small)
    words = materialise(word_index(texts), "words")
    pairs = materialise(contained_in(words.select("word").distinct(), needles), "pairs")
    return words.join(sized_side(pairs), "word").select("paper_id", "needle_id").distinct()


def _counted(
    texts: DataFrame, wanted: list[tuple[int, int, int]], needles: list[tuple[str, int]], days: list[tuple[int, str]] | None = None
) -> DataFrame:
    """(run_id, paper_id, matches) of each text row by itself, from one pass over the texts.

    ``wanted`` holds (run_id, needle_id, times). A row's hits are counted where it is read, so no hit is shuffled or kept.
    With ``days``, distinct (run_id, day), a text comes with ``places`` and a run meets those of its days, whose fields are added.
    """
    schema = f"run_id bigint, paper_id {texts.schema['paper_id'].dataType.simpleString()}, matches bigint"
    names = [] if days is None else texts.schema["places"].dataType.elementType.fields
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in names)
    if not wanted:
        return texts.sparkSession.createDataFrame([], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        runs = np.unique(np.array([r for r, _, _ in wanted], np.int64))
        of: dict[int, list[tuple[int, int]]] = {}
        for run, number, times in wanted:
            of.setdefault(number, []).append((int(np.searchsorted(runs, run)), times))
        asked = {n: tuple(np.array(column, np.int64) for column in zip(*places, strict=True)) for n, places in of.items()}
        on_day: dict[str, np.ndarray] = {}
        for run, day in days or ():
            on_day.setdefault(day, np.zeros(len(runs), bool))[runs == run] = True
        automaton = ahocorasick.Automaton()
        for needle, number in needles:
            automaton.add_word(needle, number)
        automaton.make_automaton()
        counts = np.zeros(len(runs), np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(s, COUNTED_ROWS)
                if names:
                    places, ends = part.column("places").values, part.column("places").offsets.to_pylist()
                    day_of = places.slice(ends[0], ends[-1] - ends[0]).field("day").to_pylist()
                rows, found, sums, at = [], [], [], []
                for k, (title, abstract) in enumerate(zip(part.column("title"), part.column("abstract"), strict=True)):
                    hits = {n for text in (title.as_py(), abstract.as_py()) for _, n in automaton.iter(text)}
                    counts[:] = 0
                    for n in hits & asked.keys():
                        which, times = asked[n]
                        counts[which] += times  # a run asks for a needle once
                    some = np.flatnonzero(counts)
                    for place in range(ends[k], ends[k + 1]) if names else (None,):
                        here = some
                        if place is not None:
                            day = day_of[place - ends[0]]
                            here = some[on_day[day][some]] if day in on_day else some[:0]
                            at.append(np.full(len(here), place))
                        rows.append(np.full(len(here), k))
                        found.append(runs[here])
                        sums.append(counts[here])
                if not rows:
                    continue
                out = [pa.array(np.concatenate(found), pa.int64()), part.column("paper_id").take(pa.array(np.concatenate(rows), pa.int64())),
                       pa.array(np.concatenate(sums), pa.int64())]
                if names:
                    out += places.take(pa.array(np.concatenate(at), pa.int64())).flatten()
                yield pa.RecordBatch.from_arrays(out, ["run_id", "paper_id", "matches", *(f.name for f in names)])

    read = ["paper_id", "title", "abstract", *(["places"] if names else [])]
    return texts.select(*read).mapInArrow(scan, schema)


def _by_copies(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts whose id no other row has, and the others, if any; ids alone are counted."""
    many = materialise(texts.groupBy("paper_id").agg(F.count("*").alias("_n")).where("_n > 1").select("paper_id"), "repeated")
    if many.isEmpty():
        return texts, None
    many = sized_side(many.withColumnRenamed("paper_id", "_id"))
    same = F.col("paper_id").eqNullSafe(F.col("_id"))
    return texts.join(many, same, "left_anti"), texts.join(many, same, "left_semi")


def _asked(runs: DataFrame) -> tuple[DataFrame, DataFrame, list | None, list | None]:
    """Filter keywords as numbered needles and as (run_id, needle_id, times); both also as lists, if every task may hold them."""
    wanted = filter_keywords(runs).withColumnRenamed("keyword", "needle")
    needles = numbered_needles(wanted)
    wanted = wanted.join(needles, "needle").select("run_id", "needle_id", "times")
    small = _handed_out(needles)
    if small is None or wanted.count() * 24 > NEEDLE_BYTES:
        return needles, wanted, None, None
    return needles, wanted, small, [tuple(r) for r in wanted.collect()]


def substring_hits(runs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(run_id, paper_id, matches): papers that contain at least one filter keyword of a run.

    ``matches`` counts repeated keywords of the prompt each time. Runs without any filter
    keyword pass every paper and are left to :func:`unfiltered_runs`. Hits are counted where a paper is read; only
    papers whose id stands in several rows, and searches too many for that, go through an aggregate.
    """
    needles, wanted, small, asked = _asked(runs)
    texts = lower_texts(corpus)
    summed = lambda hits: hits.groupBy("run_id", "paper_id").agg(F.sum("matches").alias("matches"))
    if small is not None:
        single, copies = _by_copies(texts)
        found = _counted(single, asked, small)
        return found if copies is None else found.unionByName(summed(_counted(copies, asked, small)))
    found = substring_papers(texts, needles)
    return summed(found.join(sized_side(wanted), "needle_id").withColumnRenamed("times", "matches"))


def placed_hits(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """(run_id, paper_id, matches and the fields of a place): hits of :func:`substring_hits` at the places of a run's day.

    ``runs`` holds as_of. ``texts`` holds paper_id, unique, title, abstract and ``places``, structs that name their ``day``,
    as_of as text. A run meets the places of its day where the text is read, so hits are joined with no table of places.
    """
    days = runs.where(F.col("run_id").isNotNull() & F.col("as_of").isNotNull()).select("run_id", F.col("as_of").cast("string").alias("day"))
    needles, wanted, small, asked = _asked(runs.where(F.col("run_id").isNotNull()))
    if small is not None:
        found = _counted(lower_texts(texts, "places"), asked, small, [tuple(r) for r in days.distinct().collect()])
    else:
        hits = substring_papers(lower_texts(texts), needles).join(sized_side(wanted), "needle_id")
        hits = hits.groupBy("run_id", "paper_id").agg(F.sum("times").alias("matches"))
        placed = texts.select("paper_id", F.inline("places"))
        found = hits.join(sized_side(days.distinct()), "run_id").join(placed, ["paper_id", "day"])
    return found.join(sized_side(days), ["run_id", "day"]).drop("day")  # a run that is there twice has its hits twice


def unfiltered_runs(runs: DataFrame) -> DataFrame:
    """Runs without any filter keyword."""
    return runs.join(filter_keywords(runs).select("run_id").distinct(), "run_id", "left_anti")


def phrase_queries(queries: DataFrame) -> DataFrame:
    """(run_id, query_no, phrase) of the queries that have words but no keywords."""
    return (
        queries.where(F.size(keywords(F.col("query"))) == 0)
        .select("run_id", "query_no", strip(F.lower(F.col("query"))).alias("phrase"))
        .where(F.col("phrase") != "")
    )


def phrase_hits(phrases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Papers whose title or abstract holds the whole phrase.

    Phrases that are too many for an automaton are narrowed by their longest word; the whole phrase is then looked up in
    those papers only.
    """
    shown = ["run_id", "query_no", "paper_id", F.lit(PHRASE).alias("strategy_no"), F.lit(1).alias("matched")]
    texts = lower_texts(corpus)
    whole = numbered_needles(phrases.select(F.col("phrase").alias("needle")))
    small = _handed_out(whole)
    if small is not None:
        asked = phrases.join(whole, F.col("phrase") == F.col("needle")).select("run_id", "query_no", "needle_id")
        return scanned(texts, small).join(sized_side(asked), "needle_id").select(*shown)
    longest = F.array_max(
        F.transform(
            split_words(F.col("phrase")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))
        )
    )["w"]
    phrases = phrases.withColumn("needle", longest)
    needles = numbered_needles(phrases)
    wanted = phrases.join(needles, "needle").select("run_id", "query_no", "phrase", "needle_id")
    narrowed = materialise(
        substring_papers(texts, needles).join(sized_side(wanted), "needle_id"), "narrowed"
    )
    holds = F.contains(F.col("title"), F.col("phrase")) | F.contains(F.col("abstract"), F.col("phrase"))
    return texts.join(sized_side(narrowed), "paper_id").where(holds).select(*shown)
