"""First hits of strategies from postings in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake import session
from paperlake.operators import match, postings
from paperlake.operators.ranking import prefix_cap

WORDS = ["protein", "folding", "lattice", "neural", "cancer", "genome", "quantum", "climate"]
KEYS = ["run_id", "query_no", "strategy_no"]


@pytest.fixture(scope="module")
def papers(spark):
    """3,000 papers; the first word is in nearly all, later ones are rarer and rarer; some rows are repeated or null."""
    rng = random.Random(7)
    pick = lambda: " ".join(w for k, w in enumerate(WORDS) if rng.random() < 0.97 / (k + 1))
    rows = [(i, pick(), pick()) for i in range(3000)]
    rows += [(17, "protein folding lattice", "again"), (18, None, "genome"), (19, "quantum", None), (3001, "", "")]
    return spark.createDataFrame(rows, "paper_id bigint, title string, abstract string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, 0, "protein"), (1, 1, "protein folding lattice neural cancer genome quantum"), (2, 0, "climate quantum genome"),
            (2, 1, "protein protein folding"), (3, 0, "absent words here"), (4, 0, "the of"), (5, 0, "protein folding")]
    return spark.createDataFrame(rows, "run_id bigint, query_no int, query string")


def expected(queries, papers, limits, most):
    hits = match.strategy_hits(match.keyword_hits(queries, match.token_index(papers)))
    capped = prefix_cap(hits.join(limits, "run_id"), KEYS, [F.desc("matched"), "paper_id"], F.col("bound"), most=most)
    return sorted(tuple(r) for r in capped.select(*KEYS, "paper_id", "matched").collect())


@pytest.mark.parametrize("n_blocks, bounds, limit", [(1, 5, None), (20, 1, None), (20, 60, None), (7, 5000, 0)])
def test_first_hits_equal_all_hits_cut(spark, papers, queries, monkeypatch, n_blocks, bounds, limit):
    if limit is not None:  # merge joins
        monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    limits = spark.createDataFrame([(i, bounds + i % 2) for i in range(1, 6)], "run_id bigint, bound int")
    got = postings.first_hits(queries, postings.blocked_postings(papers, n_blocks), limits, bounds + 1)
    assert sorted(tuple(r) for r in got.select(*KEYS, "paper_id", "matched").collect()) == expected(queries, papers, limits, bounds + 1)


def test_rows_built_follow_the_bounds(spark, papers, queries, monkeypatch):
    built, real = [], postings.hits_in_blocks

    def counted(*args):
        found = session.materialise(real(*args), "counted")
        built[-1] += found.count()
        return found

    monkeypatch.setattr(postings, "hits_in_blocks", counted)
    index = postings.blocked_postings(papers, 60)
    one = queries.where("run_id = 5")
    for bound in (10, 200):
        built.append(0)
        limits = spark.createDataFrame([(5, bound)], "run_id bigint, bound int")
        assert postings.first_hits(one, index, limits, bound).count() == 3 * bound
    whole = match.strategy_hits(match.keyword_hits(one, match.token_index(papers))).count()
    assert built[0] < 0.15 * whole and built[0] < built[1] < 0.7 * whole


def test_empty_sides(spark, papers, queries):
    limits = spark.createDataFrame([(1, 5)], "run_id bigint, bound int")
    index = postings.blocked_postings(papers, 3)
    assert postings.first_hits(queries.limit(0), index, limits, 5).count() == 0
    assert postings.first_hits(queries, index, limits.limit(0), 0).count() == 0
    assert postings.first_hits(queries, postings.blocked_postings(papers.limit(0), 3), limits, 5).count() == 0
