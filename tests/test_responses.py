import pytest
from pyspark.sql import functions as F

from paperlake.functions.noisy_json import query_list
from paperlake.operators import extract
from paperlake.operators.queries import run_queries

#: response: objects with their places
OBJECTS = {
    '```json\n[{"a": 1.0, "b": null}]\n```': {0: {"a": "1.0", "b": None}},
    'Sure! [{"a": "x"}, 7, "{\\"z\\": 1}", null, [1]] hope this helps': {0: {"a": "x"}},
    '[3, {"a": "x"}, {"b": "y"}]': {1: {"a": "x"}, 2: {"b": "y"}},
    '[1] and [{"a": 1}]': {},
    '[{"a": 1},]': {},
    "[{'a': 1}]": {},
    '[{"a": "line\nbreak"}]': {},
    "[]": {}, "none": {}, "": {}, "{}": {}, "[[[": {}, "[01]": {}, '[{"a" 1}]': {},
    '[{"a": 1, "a": 2, "b": 3}]': {0: {"a": "2", "b": "3"}},
    '[{"a": {"b": [1, 2]}, "c": true}]': {0: {"a": '{"b":[1,2]}', "c": "true"}},
    '[{"a": 1}}]': {}, '[{"a": 1}]}': {0: {"a": "1"}}, '[1],"y":[2]': {}, '[{"a": 1}]} and [2]': {},
    "[[1]],[[2]]": {}, "[1]] [2]": {},
    '[{"a": "[1] foo"}, {"b": "{"}]': {0: {"a": "[1] foo"}, 1: {"b": "{"}},
    '["{", {"a": "\\u007b"}]': {1: {"a": "{"}},
    '["\\u007b\\"q\\": 1}"]': {},
    '[{"é": "ü"}]': {0: {"é": "ü"}},
    'first ``` [{"a": ""}] ``` last': {0: {"a": ""}},
    'x [{"a": 1}] y ]': {},
    'x [ [{"a": 1}] y': {},
}


def test_objects_of_noisy_responses(spark):
    df = spark.createDataFrame([*enumerate(OBJECTS), (-1, None)], "i int, response string")
    got = {t: {} for t in OBJECTS}
    for row in extract.response_objects(df, ["i"]).collect():
        got[list(OBJECTS)[row["i"]]][row["element_no"]] = row["fields"]
    assert got == OBJECTS


META = {"title": "T", "authors": "A, B", "published_date": "2024-01-01", "doi": "", "url": "u1", "pdf_url": "",
        "categories": "c", "source": "arXiv"}


def papers(spark, text="TITLE: T\nABSTRACT: body"):
    schema = ("run_id bigint, paper_no int, paper_id bigint, url string, text string, meta struct<"
              + ", ".join(f"{k}: string" for k in META) + ">")
    return spark.createDataFrame([(1, 1, 10, "http://long.example/" + "x" * 40, text, tuple(META.values()))], schema)


def records_of(spark, response, error=None):
    df = spark.createDataFrame([(1, 10, 0, response, error)],
                               "run_id bigint, paper_id bigint, attempt int, response string, error string")
    rows = extract.response_records(papers(spark), df).orderBy("element_no").collect()
    return [r["fields"] for r in rows]


def test_back_fill_keeps_true_values_and_adds_the_rest(spark):
    got = records_of(spark, '[{"title": "null", "doi": null, "url": 0, "source": false, "pdf_url": "p", "x": ""}]')
    assert got == [{**META, "title": "null", "pdf_url": "p", "x": ""}]


def test_fallback_records(spark):
    assert records_of(spark, "[]") == [META]
    assert records_of(spark, "[3, \"x\"]") == [META]
    filled = {k: v for k, v in META.items() if v}
    assert records_of(spark, None, "boom") == [{**filled, "abstract": "body"}]


def test_error_rows(spark):
    df = spark.createDataFrame([(1, 10, 0, None, "boom")],
                               "run_id bigint, paper_id bigint, attempt int, response string, error string")
    row = extract.response_errors(papers(spark), df).first()
    assert row["message"] == "Extract http://long.example/" + "x" * 20 + ": boom"


@pytest.mark.parametrize("text, fields", [
    ("no labels", {}),
    ("ABSTRACT: ", {"abstract": ""}),
    ("ABSTRACT:\n one\n two \n", {"abstract": "one\n two"}),
    ("x JOURNAL: \n Next line\nmore", {"journal": "Next line"}),
    ("JOURNAL: a\rb c\nd", {"journal": "a\rb c"}),
    ("JOURNAL:", {}),
    ("ABSTRACT:  　", {"abstract": ""}),
    ("JOURNAL: J\nABSTRACT: z\nJOURNAL: K", {"journal": "J", "abstract": "z\nJOURNAL: K"}),
])
def test_metadata_record(spark, text, fields):
    row = extract.metadata_records(papers(spark, text)).first()
    assert row["fields"] == {**{k: v for k, v in META.items() if v}, **fields}
    assert row["source"] == "arXiv"


def test_query_lists(spark):
    rows = ['x {"queries": ["a", "b"]} y', '{"queries": []}', '{"queries": "a"}', "none", '{"a": 1} {"queries": ["z"]}']
    runs = spark.createDataFrame([(i, "alpha beta gamma delta words") for i in range(len(rows))], "run_id bigint, prompt string")
    answers = spark.createDataFrame(list(enumerate(rows)), "run_id bigint, response string")
    assert [r[0] for r in answers.select(query_list(F.col("response"))).collect()][:2] == [["a", "b"], []]
    got = {}
    for r in run_queries(runs, answers).orderBy("run_id", "query_no").collect():
        got.setdefault(r["run_id"], []).append(r["query"])
    own = ["alpha beta gamma delta", "alpha beta gamma recent", "beta gamma delta words"]
    assert got == {0: ["a", "b"], 1: own, 2: own, 3: own, 4: own}


def test_prompt_shows_the_window(spark):
    runs = spark.createDataFrame([(1, ["title", "doi"])], "run_id bigint, fields array<string>")
    prompt = extract.prompts(papers(spark, "x" * 5000), runs, window=4000).first()["prompt"]
    assert "title | doi" in prompt and "x" * 4000 in prompt and "x" * 4001 not in prompt
    assert "x" * 5000 in extract.prompts(papers(spark, "x" * 5000), runs).first()["prompt"]
    assert [r["attempt"] for r in extract.prompts(papers(spark), runs, attempts=3).orderBy("attempt").collect()] == [0, 1, 2]
    assert extract.prompts(papers(spark), runs, attempts=0).count() == 0
    lacking = spark.createDataFrame([(1, ["no doi", "short"])], "run_id bigint, issues array<string>")
    later = extract.prompts(papers(spark), runs, first=2, issues=lacking).first()
    assert later["attempt"] == 2 and later["issues"] == ["no doi", "short"] and "no doi; short" in later["prompt"]


def test_landed_answers_of_the_asked_attempt_only(spark):
    schema = "run_id bigint, paper_id bigint, attempt int, response string, error string"
    answers = spark.createDataFrame([(1, 10, 0, "a", None), (1, 10, 1, "b", None), (2, 10, 1, "c", None)], schema)
    asked = spark.createDataFrame([(1, 10, 1)], "run_id bigint, paper_id bigint, attempt int")
    assert [r["response"] for r in extract.landed_responses(answers)(asked).collect()] == ["b"]


def test_repeated_responses_count_once(spark):
    schema = "run_id bigint, paper_id bigint, attempt int, response string, error string"
    answers = spark.createDataFrame([(1, 10, 0, None, "late"), (1, 10, 0, '[{"x": "b"}]', None), (1, 10, 0, '[{"x": "a"}]', None)], schema)
    assert [r["fields"]["x"] for r in extract.response_records(papers(spark), answers).collect()] == ["a"]
    assert extract.response_errors(papers(spark), answers).count() == 0


def test_papers_without_a_response_stay(spark):
    two = papers(spark).union(papers(spark).withColumn("paper_id", F.lit(11).cast("bigint")))
    schema = "run_id bigint, paper_id bigint, attempt int, response string, error string"
    answers = spark.createDataFrame([(1, 10, 0, '[{"x": "a"}]', None), (1, 10, 1, "[]", None), (1, 11, 1, "[]", None)], schema)
    rows = extract.response_records(two, answers).collect()
    assert {(r["paper_id"], r["attempt"], r["fields"].get("x")) for r in rows} == {
        (10, 0, "a"), (11, 0, None), (10, 1, None), (11, 1, None)}
    assert len(rows) == 4 and all(r["fields"]["title"] == "T" for r in rows)
    assert [(r["ref"], r["message"].split(": ")[1]) for r in extract.response_errors(two, answers).collect()] == [("11", "no response")]
    none = spark.createDataFrame([], schema)
    assert {(r["paper_id"], r["attempt"]) for r in extract.response_records(two, none).collect()} == {(10, 0), (11, 0)}
    assert extract.response_errors(two, none).count() == 2


def test_one_query_list_per_run(spark):
    runs = spark.createDataFrame([(1, "alpha beta gamma delta words")], "run_id bigint, prompt string")
    answers = spark.createDataFrame(
        [(1, 2, '{"queries": ["late"]}'), (1, 0, '{"queries": []}'), (1, 1, '{"queries": ["b", "c"]}')],
        "run_id bigint, attempt int, response string")
    got = run_queries(runs, answers).orderBy("query_no").collect()
    assert [(r["query_no"], r["query"], r["n_queries"]) for r in got] == [(0, "b", 2), (1, "c", 2)]
