"""From runs to the papers of each run: both sources, in priority order, deduplicated, capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import title_key
from paperlake.operators import match, postings
from paperlake.operators.queries import fetch_bound, per_query_budget, run_queries
from paperlake.operators.ranking import first_wins, prefix_cap
from paperlake.operators.windows import date_windows_of
from paperlake.session import materialise, sized_side

UNION_ORDER = ["source_no", "query_no", "step_no", "position", "paper_id"]


def budgets(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """(run_id, max_papers, budget, bound) from the run caps and the number of queries."""
    counted = queries.select("run_id", "n_queries").distinct()
    budget = per_query_budget(F.col("max_papers"), F.coalesce(F.col("n_queries"), F.lit(0)))
    return runs.join(counted, "run_id", "left").select(
        "run_id", "max_papers", budget.alias("budget"), fetch_bound(budget).alias("bound")
    )


def largest(limits: DataFrame) -> dict[str, int]:
    """The largest of each cap over all runs; three numbers that let Spark prune early."""
    row = limits.agg(*[F.max(c).alias(c) for c in ("max_papers", "budget", "bound")]).first()
    return {c: v or 0 for c, v in row.asDict().items()}


def strategy_union(
    queries: DataFrame, corpus: DataFrame, limits: DataFrame, most: dict[str, int], index: DataFrame | None = None
) -> DataFrame:
    """All strategies of all queries, each cut to its fetch bound.

    Within a strategy papers stand in order of matched keywords, then of id. With ``index``, from
    :func:`postings.blocked_postings`, hits beyond the bounds are not built. The phrase strategy
    reads the corpus twice more, so it is planned only when some query has no keywords.
    """
    if index is None:
        hits = match.strategy_hits(match.paper_hits(queries, corpus))
    else:
        hits = postings.first_hits(queries, index, limits, most["bound"])
    phrases = match.phrase_queries(queries)
    if not phrases.isEmpty():
        hits = hits.unionByName(match.phrase_hits(phrases, corpus))
    return prefix_cap(
        hits.join(limits.select("run_id", "bound"), "run_id"),
        ["run_id", "query_no", "strategy_no"],
        [F.desc("matched"), "paper_id"],
        F.col("bound"),
        rank_name="position",
        most=most["bound"],
    ).drop("bound")


def query_papers(union: DataFrame, limits: DataFrame, most: dict[str, int]) -> DataFrame:
    """First appearance of each paper within a query, cut to the query's budget."""
    order = ["strategy_no", "position"]
    distinct = first_wins(union, ["run_id", "query_no", "paper_id"], order)
    return prefix_cap(
        distinct.join(limits.select("run_id", "budget"), "run_id"),
        ["run_id", "query_no"], order, F.col("budget"), most=most["budget"],
    ).drop("budget")


def feed_window_items(
    items: DataFrame, days: DataFrame, page_size: int = 100, max_pages: int | None = None
) -> DataFrame:
    """Feed items in the date windows of each reference day of ``days`` (as_of).

    With ``max_pages`` only so many pages of a server's window are taken, counted before any keyword filter: the
    bound of a live feed. A landed feed needs none and is read whole.
    """
    placed = date_windows_of(items, "published", days)
    if max_pages is None:
        return placed
    return prefix_cap(
        placed, ["as_of", "server_no", "window_no"], ["feed_pos", "paper_id"], page_size * max_pages,
    )


def feed_matches(runs: DataFrame, once: DataFrame) -> DataFrame:
    """Items of the feed that hold a filter word of a run: (run_id, paper_id, places, matches).

    ``runs`` holds as_of. Words are looked up once, however many reference days an item belongs to.
    """
    texts = once.select("paper_id", "title", "abstract").dropDuplicates(["paper_id"])
    places = once.select("as_of", "paper_id", "server_no", "window_no", "feed_pos")
    hits = match.substring_hits(runs, texts)
    return hits.join(sized_side(runs.select("run_id", "as_of")), "run_id").join(places, ["as_of", "paper_id"])


def preprint_papers(
    runs: DataFrame, feed: DataFrame, limits: DataFrame, most: dict[str, int]
) -> DataFrame:
    """Preprints of each run that has the source switched on.

    ``runs`` holds as_of. Both servers share one cap per run; an item that lies in two windows counts once. The feed is written
    once, with its texts; items are then placed without them, however many reference days and windows they lie in.
    """
    wanted = runs.where(~F.col("no_preprint"))
    caps = limits.select("run_id", F.greatest("budget", F.lit(50)).alias("cap"))
    slots_at_most = max(most["budget"], 50)
    order = ["server_no", "window_no", "feed_pos", "paper_id"]
    feed = feed.select("paper_id", "title", "abstract", "published", "server_no", "feed_pos")
    feed = materialise(feed.withColumn("_row", F.monotonically_increasing_id()), "feed")
    placed = feed_window_items(feed.drop("title", "abstract"), runs.select("as_of")).drop("published")
    once = materialise(first_wins(placed, ["as_of", "paper_id"], order), "places")
    place = F.struct(F.col("as_of").cast("string").alias("day"), F.col("paper_id").alias("item"), "server_no", "window_no", "feed_pos")
    places = once.where(F.col("paper_id").isNotNull()).groupBy("_row").agg(F.collect_list(place).alias("places"))
    texts = feed.select(F.col("_row"), "title", "abstract").join(sized_side(places), "_row").withColumnRenamed("_row", "paper_id")
    hits = match.placed_hits(wanted, texts).drop("paper_id").withColumnRenamed("item", "paper_id")
    capped = prefix_cap(hits.join(caps, "run_id"), ["run_id"], order, F.col("cap"), rank_name="position", most=slots_at_most)

    # A run without keywords takes the head of its day's feed: position k of the run meets item k.
    free = match.unfiltered_runs(wanted).select("run_id", "as_of").join(caps, "run_id")
    head = prefix_cap(
        once.select("as_of", "paper_id", "server_no", "window_no", "feed_pos"), ["as_of"], order, slots_at_most,
        rank_name="position", most=slots_at_most,
    )
    slots = free.withColumn("position", F.explode(F.sequence(F.lit(1), F.col("cap"))))
    unfiltered = slots.join(head, ["as_of", "position"]).withColumn("matches", F.lit(0).cast("long"))
    columns = ["run_id", "paper_id", "server_no", "window_no", "position", "matches"]
    return capped.select(*columns).unionByName(unfiltered.select(*columns))


def ordered_union(by_query: DataFrame, preprints: DataFrame | None = None) -> DataFrame:
    """Hits of both sources under one total order per run."""
    first = by_query.select(
        "run_id", "paper_id", F.lit(1).alias("source_no"), "query_no",
        F.col("strategy_no").alias("step_no"), F.col("position").cast("long").alias("position"),
    )
    if preprints is None:
        return first
    second = preprints.select(
        "run_id", "paper_id", (F.col("server_no") + 2).alias("source_no"),
        F.lit(0).alias("query_no"), F.col("window_no").alias("step_no"),
        F.col("position").cast("long").alias("position"),
    )
    return first.unionByName(second)


def unique_titles(union: DataFrame, titles: DataFrame) -> DataFrame:
    """First hit per run and title in union order; untitled papers drop out.

    ``titles`` holds (paper_id, title). The caps bound ``union``, which should be a written table: it is measured and, if
    it is small, handed to the scan of the titles, so only titles of hits leave that scan.
    """
    keyed = titles.select("paper_id", title_key(F.col("title")).alias("title_key")).join(
        sized_side(union), "paper_id"
    ).where(F.col("title_key") != "")
    return first_wins(keyed, ["run_id", "title_key"], UNION_ORDER)


def select_papers(unique: DataFrame, runs: DataFrame, most: dict[str, int]) -> DataFrame:
    """The first ``max_papers`` hits of each run; ``paper_no`` is the place in the run."""
    capped = prefix_cap(
        unique.join(runs.select("run_id", "max_papers"), "run_id"),
        ["run_id"], UNION_ORDER, F.col("max_papers"), rank_name="paper_no",
        most=most["max_papers"],
    )
    return capped.drop("max_papers")


def search(
    runs: DataFrame,
    corpus: DataFrame,
    preprints: DataFrame | None = None,
    as_of: Column | None = None,
    responses: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """(run_id, paper_no, paper_id, …): the papers of every run.

    ``as_of``, an expression over ``runs``, is the day a run's windows of the feed count back from; each run may
    have its own. ``index`` is the corpus' blocked postings, if it is kept; without one all hits are built.
    """
    queries = materialise(run_queries(runs, responses), "queries")
    limits = materialise(budgets(runs, queries), "limits")
    most = largest(limits)
    by_query = query_papers(strategy_union(queries, corpus, limits, most, index), limits, most)
    titles = corpus.select("paper_id", "title")
    second = None
    if preprints is not None:
        dated = runs.withColumn("as_of", as_of)
        second = preprint_papers(dated, preprints, limits, most)
        titles = titles.unionByName(preprints.select("paper_id", "title"))
    union = materialise(ordered_union(by_query, second), "union")
    return select_papers(unique_titles(union, titles), runs, most)


def step_counters(union: DataFrame, unique: DataFrame) -> DataFrame:
    """Per run, source, query and step: papers matched and papers that were new."""
    keys = ["run_id", "source_no", "query_no", "step_no"]
    matched = union.groupBy(*keys).agg(F.count("*").alias("matched"))
    new = unique.groupBy(*keys).agg(F.count("*").alias("new_unique"))
    return matched.join(new, keys, "left").fillna(0, ["new_unique"])


def window_counters(items: DataFrame) -> DataFrame:
    """Per reference day, server and window: items scanned."""
    return items.groupBy("as_of", "server_no", "window_no").agg(F.count("*").alias("scanned"))


def run_window_counters(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Per run with filter words, server and window of its day: items scanned, items that match, and those of them
    that no earlier window had. ``runs`` holds as_of."""
    order = ["server_no", "window_no", "feed_pos", "paper_id"]
    items = materialise(items, "feed")
    matched = materialise(feed_matches(runs, items).select("run_id", *order), "matched")
    keys = ["run_id", "server_no", "window_no"]
    counts = matched.groupBy(*keys).agg(F.count("*").alias("matched"))
    new = first_wins(matched, ["run_id", "paper_id"], order).groupBy(*keys).agg(F.count("*").alias("new"))
    asked = runs.join(match.unfiltered_runs(runs).select("run_id"), "run_id", "left_anti").select("run_id", "as_of")
    every = asked.join(sized_side(window_counters(items)), "as_of").drop("as_of")
    return every.join(counts, keys, "left").join(new, keys, "left").fillna(0, ["matched", "new"])
