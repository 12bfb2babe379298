"""Conditional retries: who is asked how often, and which attempt stands."""

import pytest
from pyspark.sql import functions as F

from paperlake.operators import extract
from paperlake.plans.retries import extract_with_retries

META = "struct<title: string, authors: string, published_date: string, doi: string, url: string, pdf_url: string, categories: string, source: string>"
GOOD, WEAK = '[{"kind": "x", "year": 1}]', "[]"
#: run: responses to the attempts 0, 1, ... of each of its papers; None: no row
ANSWERS = {
    1: [[GOOD, GOOD, GOOD], [GOOD, GOOD, GOOD]],  # good at once
    2: [[WEAK, GOOD, GOOD], [WEAK, GOOD, GOOD]],  # good at the second
    3: [[WEAK, WEAK, WEAK], [WEAK, WEAK, GOOD]],  # better at the third, accepted in any case
    4: [[WEAK, WEAK, WEAK], [WEAK, WEAK, WEAK]],  # never good
    5: [[WEAK, None, None], [WEAK, None, None]],  # no later responses: the first attempt stands
    6: [[None, GOOD, None], [None, None, None]],  # one late answer
}


@pytest.fixture(scope="module")
def tables(spark):
    runs = spark.createDataFrame([(r, ["kind", "year"]) for r in [*ANSWERS, 7]], "run_id bigint, fields array<string>")
    blank = ("", "", "", "", "", "", "", "arXiv")
    papers = spark.createDataFrame([(r, p, p, f"u{p}", "t", blank) for r, a in ANSWERS.items() for p in range(len(a))],
                                   f"run_id bigint, paper_no int, paper_id bigint, url string, text string, meta {META}")
    rows = [(r, p, k, x, None) for r, a in ANSWERS.items() for p, xs in enumerate(a) for k, x in enumerate(xs) if x]
    answers = spark.createDataFrame(rows, "run_id bigint, paper_id bigint, attempt int, response string, error string")
    return runs, papers, answers


def counted(answers, seen):
    def respond(asked):
        seen.append({(r["run_id"], r["attempt"]): (r["count"], r["lacks"]) for r in
                     asked.groupBy("run_id", "attempt").agg(F.count("*").alias("count"), F.first("issues").alias("lacks")).collect()})
        return extract.landed_responses(answers)(asked)

    return respond


def test_only_weak_runs_are_asked_again(tables):
    runs, papers, answers = tables
    seen = []
    done = extract_with_retries(runs, papers, counted(answers, seen))
    assert [sorted(s) for s in seen] == [
        [(r, 0) for r in range(1, 7)], [(r, 1) for r in range(2, 7)], [(3, 2), (4, 2)]]
    assert all(n == 2 and bool(lacks) == (k > 0) for s in seen for (_, k), (n, lacks) in s.items())
    assert {r["run_id"]: r["attempt"] for r in done.chosen.collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 0, 6: 1, 7: 0}
    scores = {(r["run_id"], r["attempt"]): r["score"] for r in done.marks.collect()}
    assert scores == {(1, 0): 1.0, (2, 0): 0.35, (2, 1): 1.0, (3, 0): 0.35, (3, 1): 0.35, (3, 2): 1.0, (4, 0): 0.35,
                      (4, 1): 0.35, (4, 2): 0.35, (5, 0): 0.35, (6, 0): 0.35, (6, 1): 1.0, (7, 0): 0.0}
    assert {(r["run_id"], r["attempt"]) for r in done.records.collect()} == {(1, 0), (2, 1), (3, 2), (4, 2), (5, 0), (6, 1)}
    assert done.errors.count() == 3  # run 6: both papers at first, one at the second attempt


def test_no_retries(tables):
    runs, papers, answers = tables
    seen = []
    done = extract_with_retries(runs, papers, counted(answers, seen), retries=0)
    assert len(seen) == 1 and {r["attempt"] for r in done.chosen.collect()} == {0}


def test_good_runs_end_the_loop(tables):
    runs, papers, answers = tables
    seen = []
    one = extract_with_retries(runs.where("run_id = 1"), papers.where("run_id = 1"), counted(answers, seen))
    assert len(seen) == 1 and one.records.count() == 2


def test_no_papers(tables):
    runs, papers, answers = tables
    done = extract_with_retries(runs, papers.limit(0), extract.landed_responses(answers))
    assert done.records.count() == 0 and {r["score"] for r in done.marks.collect()} == {0.0}
