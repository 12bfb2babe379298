import pytest
from pyspark.sql import functions as F

from paperlake.operators import merge, quality
from paperlake.sources.runs import run_table


def runs_of(spark, specs):
    rows = [(i, "", list(f), 150, 0.92, False) for i, f in specs.items()]
    return spark.createDataFrame(rows, "run_id bigint, prompt string, fields array<string>, max_papers int, "
                                       "dedup_threshold double, no_preprint boolean")


def records_of(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, paper_no int, element_no int, fields map<string,string>")


X, N = {"a": "x", "b": "y"}, {"a": None}
LOW_12 = "Overall field coverage low (12%)"
#: fields, records, coverage, primary rate, score, issues
MARKS = [
    (["a"], [], 0.0, 0.0, 0.0, ["No records extracted"]),
    (["a", "b"], [X, X], 1.0, 1.0, 1.0, []),
    # borders: 0.3 and 0.4 are enough
    (["a"], [X] * 3 + [N] * 7, 0.3, 0.3, 0.7, ["Primary field 'a' sparse (3/10)"]),
    (["a"], [X] * 4 + [N] * 6, 0.4, 0.4, 1.0, []),
    (["b", "a"], [{"a": "x"}] * 3 + [{"b": "x"}] * 2, 0.5, 0.4, 1.0, []),
    (["a", "b", "c"], [{"a": "x"}] * 8 + [N] * 2, 8 / 30, 0.8, 0.5, ["Overall field coverage low (27%)"]),
    (["a", "b"], [{"b": "x"}] + [N] * 3, 0.125, 0.0, 0.35, [LOW_12, "Primary field 'a' sparse (0/4)"]),
    # a text that says nothing fills no cell, but counts for the first field
    (["a"], [{"a": "null"}, {"a": "None"}, {"a": "none"}, {"a": " "}], 0.0, 1.0, 0.5, ["Overall field coverage low (0%)"]),
    (["a"], [{"a": "0"}, {"a": "false"}, {"a": "[]"}, {"a": "{}"}, {"a": ""}], 0.0, 0.0, 0.35,
     ["Overall field coverage low (0%)", "Primary field 'a' sparse (0/5)"]),
    (["a"], [{"a": "NULL"}, {"a": "0.1"}, {"a": "-"}], 1.0, 1.0, 1.0, []),
]


def test_quality(spark):
    records = records_of(spark, [(i, n, 0, r) for i, m in enumerate(MARKS) for n, r in enumerate(m[1])])
    runs = runs_of(spark, {i: m[0] for i, m in enumerate(MARKS)})
    got = {r["run_id"]: r for r in quality.run_quality(records, runs).collect()}
    assert set(got) == set(range(len(MARKS)))
    for i, (_, rows, coverage, primary, score, issues) in enumerate(MARKS):
        assert got[i]["n_records"] == len(rows) and got[i]["issues"] == issues, i
        assert (got[i]["coverage"], got[i]["primary_rate"], got[i]["score"]) == pytest.approx((coverage, primary, score)), i


def test_attempts(spark):
    marks = spark.createDataFrame(
        [(1, 0, 0.5), (1, 1, 1.0), (2, 0, 0.35), (2, 1, 0.7), (3, 0, 0.35), (3, 1, 0.0), (3, 2, 0.35),
         (4, 0, 0.0), (5, 0, 0.0), (5, 1, 0.0), (5, 2, 0.0), (5, 3, 1.0), (6, None, 0.0)],
        "run_id bigint, attempt int, score double")
    assert {r["run_id"]: r["attempt"] for r in quality.select_attempts(marks).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 2, 6: 2}


def test_normalise(spark):
    cases = [
        ({" Ti-tle ": "a", "TI TLE": " b "}, {"ti_tle": "b"}),
        ({"x": "[1] foo", "y": '["p", null, 3, {"k": 1}]', "z": None}, {"x": "[1] foo", "y": 'p, None, 3, {"k":1}', "z": ""}),
        ({"n": "1.0", "t": "true", "o": '{"a": 1}'}, {"n": "1.0", "t": "true", "o": '{"a": 1}'}),
        ({}, {}),
    ]
    df = records_of(spark, [(1, i, 0, c[0]) for i, c in enumerate(cases)])
    got = {r["paper_no"]: r["fields"] for r in merge.normalised(df).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_exact_dedup(spark):
    rows = [(1, 0, 0, {"title": "a", "doi": "1", "x": "p"}), (1, 1, 0, {"title": "a", "doi": "1", "x": "q"}),
            (1, 2, 0, {"other": "z"}), (1, 3, 0, {"title": "", "doi": ""}), (1, 3, 1, {"title": "a"}),
            (2, 0, 0, {"title": "a", "doi": "1"})]
    runs = runs_of(spark, {1: ["Title", "doi"], 2: ["title"]})
    got = merge.exact_dedup(records_of(spark, rows).repartition(4), runs).collect()
    assert sorted((r["run_id"], r["paper_no"], r["element_no"]) for r in got) == [(1, 0, 0), (1, 2, 0), (1, 3, 1), (2, 0, 0)]


def test_similarity_dedup_of_records(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, 0, 0, {"title": long}), (1, 0, 1, {"title": long + " extra"}), (1, 1, 0, {"title": "other words here"}),
            (1, 2, 0, {"title": ""}), (1, 3, 0, {"title": ""}), (2, 0, 0, {"title": long}), (2, 5, 0, {"title": long.upper()})]
    runs = runs_of(spark, {1: ["title"], 2: ["title"]})
    got = merge.similarity_dedup(records_of(spark, rows).repartition(3), runs).collect()
    # an empty fingerprint falls back to the whole record, so the two blank records are alike
    assert sorted((r["run_id"], r["paper_no"], r["element_no"]) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 0)]


def test_run_summary(spark):
    runs = runs_of(spark, {1: ["a"], 2: ["a"]})
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "run_id bigint")
    errors = spark.createDataFrame([(1, "extract", f"{i:02}", f"m{i}") for i in range(8)],
                                   "run_id bigint, stage string, ref string, message string")
    chosen = spark.createDataFrame([(1, 2)], "run_id bigint, attempt int")
    got = {r["run_id"]: r for r in quality.run_summary(runs, ids(1, 1), ids(1, 1, 1), chosen, errors).collect()}
    assert tuple(got[1]) == (1, 2, 3, 2, 8, ["m0", "m1", "m2", "m3", "m4"])
    assert tuple(got[2]) == (2, 0, 0, 0, 0, None)


def test_records_of_a_large_run_are_not_gathered_by_run(spark):
    """Runs derived from the records look large to Spark, which then shuffles whole records by run."""
    records = spark.range(200).select(
        (F.col("id") % 2).alias("run_id"), F.col("id").alias("paper_no"), F.lit(0).alias("element_no"),
        F.create_map(F.lit("title"), (F.col("id") % 40).cast("string")).alias("fields"),
    )
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        done = merge.exact_dedup(records, run_table(records.select("run_id").distinct(), "run_id", F.lit(""), F.lit("title")))
        plan = done._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and done.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
