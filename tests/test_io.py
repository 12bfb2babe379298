import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from paperlake.operators import extract
from paperlake.plans import collect
from paperlake.session import materialise, release_scratch, scratch_dir
from paperlake.sinks import columns, writers
from paperlake.sources import atom, papers, preprint
from paperlake.streaming import pages
from paperlake.streaming.harvest import first_arrivals, first_by_order, harvest
from paperlake.streaming.seen import SeenTitles

HEAD = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
ENTRIES = """
<entry><id> http://a/1 </id><title>A
  split   title</title><summary>  Sum
 mary </summary><published>2024-01-02T03:04:05Z</published>
 <author><name>Ann  </name></author><author><name></name></author><author><name>Bob</name></author>
 <link href="http://a/abs/1" rel="alternate"/><link title="pdf" href="http://a/x1"/><link href="http://a/pdf/1"/>
 <link href="http://dx.doi.org/10.1/Q"/><arxiv:primary_category term="cs.X"/>
 <category term="cs.Y"/><category term="cs.X"/><category term=""/></entry>
<entry><id>http://a/2</id><title>Single</title><published>2024</published><author><name>Solo</name></author></entry>
<entry><id>http://a/3</id><title>  </title><summary>no title</summary></entry>
"""


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def by_id(df):
    return {r["paper_id"]: r for r in df.collect()}


def check_atom(found):
    assert set(found) == {"http://a/1", "http://a/2"}
    one, two = found["http://a/1"], found["http://a/2"]
    assert one["text"] == ("TITLE: A split title\nAUTHORS: Ann, Bob\nDATE: 2024-01-02\nDOI: http://dx.doi.org/10.1/Q\n"
                           "CATEGORIES: cs.X, cs.Y\nABSTRACT: Sum mary")
    assert one["meta"].asDict() == {
        "title": "A split title", "authors": "Ann, Bob", "published_date": "2024-01-02", "doi": "http://dx.doi.org/10.1/Q",
        "url": "http://a/1", "pdf_url": "http://a/pdf/1", "categories": "cs.X, cs.Y", "source": "arXiv"}
    assert one["doi_norm"] == "10.1/q" and str(one["published"]) == "2024-01-02"
    assert two["meta"]["doi"] == "http://a/2" and two["meta"]["published_date"] == "2024"
    assert two["published"] is None and two["authors"] == ["Solo"] and two["abstract"] == ""


def test_atom_files_and_columns(spark, tmp_path):
    good, bad = HEAD + ENTRIES + "</feed>", HEAD + "<entry><id>http://a/9</id><title>Lost</title></entry><entry><id>"
    write(tmp_path / "feed", "p1.xml", good)
    write(tmp_path / "feed", "p2.xml", bad)
    folder = str(tmp_path / "feed")
    check_atom(by_id(atom.read_atom(spark, folder)))
    assert [r["page"].endswith("p2.xml") for r in atom.malformed_pages(spark, folder).collect()] == [True]
    pages = spark.createDataFrame([(1, good), (2, bad), (3, "")], "n int, page string")
    check_atom(by_id(atom.atom_column(pages, "page", ["n"])))


def test_preprint_pages(spark, tmp_path):
    items = [
        {"title": " T1 ", "abstract": "a", "authors": "X; Y", "doi": "10.1/z", "date": "2024-05-01", "category": "bio", "version": "3"},
        {"title": "T2", "doi": "10.1/y", "date": "2024-05-02"}, {"title": None, "abstract": None, "doi": ""}, {"title": "No Doi"},
    ]
    write(tmp_path / "b", "1.json", json.dumps({"messages": [], "collection": items}))
    write(tmp_path / "b", "2.json", json.dumps({"collection": []}))
    write(tmp_path / "b", "3.json", "{broken")
    raw = preprint.read_preprint_items(spark, str(tmp_path / "b"), "medRxiv")
    found = preprint.items_to_papers(raw)
    rows = by_id(found)
    one = rows["https://doi.org/10.1/z"]
    assert one["text"] == "TITLE: T1\nAUTHORS: X; Y\nDATE: 2024-05-01\nDOI: 10.1/z\nCATEGORY: bio\nABSTRACT: a"
    assert one["meta"]["pdf_url"] == "https://www.medrxiv.org/content/10.1/zv3.full.pdf" and one["server_no"] == 1
    assert rows["https://doi.org/10.1/y"]["meta"]["pdf_url"].endswith("10.1/yv1.full.pdf")
    assert rows["medRxiv:no doi"]["meta"]["url"] == "" and rows["medRxiv:no doi"]["meta"]["pdf_url"] == ""
    assert {r["paper_id"] for r in papers.usable(found).collect()} == set(rows) - {"medRxiv:"}
    assert [(r["stage"], r["message"]) for r in papers.rejects(found, "preprint").collect()] == [("preprint", "no title")]
    assert preprint.malformed_pages(spark, str(tmp_path / "b")).count() == 1


RECORDS = [
    {"title": 'comma, "quote"', "b": " padded ", "_hidden": "h"}, {"title": "line\nbreak", "z": ""},
    {"b": "ünï", "a_key_longer_than_twenty_six_x": "v"}, {"title": "cr\rhere"},
]


def records(spark, rows=RECORDS):
    data = [(1, i, 0, r, f"u{i}", "arXiv") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "run_id bigint, paper_no int, element_no int, fields map<string,string>, "
                                       "source_url string, source string")


def parts(folder):
    out = []
    for name in sorted(glob.glob(f"{folder}/part-*")):
        with open(name, encoding="utf-8", newline="") as f:
            out.append(f.read())
    return out


ORDER = ["title", "b", "a_key_longer_than_twenty_six_x", "z"]


def test_column_order(spark):
    assert columns.ordered_columns(records(spark), ["Title", "missing", "b", "title"]) == ORDER


def test_csv_reads_back_with_a_csv_reader(spark, tmp_path):
    assert writers.write_csv(records(spark), ["title", "b"], str(tmp_path / "csv"))
    whole = "".join(parts(tmp_path / "csv"))
    rows = list(csv.DictReader(io.StringIO(whole, newline="")))
    assert whole.count("title,b,") == 1 and rows == [{c: r.get(c, "") for c in ORDER} for r in RECORDS]
    assert "\r\n" in parts(tmp_path / "csv")[0]


def test_json(spark, tmp_path):
    assert writers.write_json(records(spark), str(tmp_path / "j"))
    lines = [json.loads(x) for t in parts(tmp_path / "j") for x in t.splitlines()]
    assert lines == [{k: v for k, v in r.items() if not k.startswith("_")} for r in RECORDS]
    assert "ünï" in "".join(parts(tmp_path / "j"))
    writers.write_json(records(spark), str(tmp_path / "ji"), include_internal=True)
    lines = [json.loads(x) for t in parts(tmp_path / "ji") for x in t.split("\n") if x]
    assert lines == [{**r, "_source_url": f"u{i}", "_source": "arXiv"} for i, r in enumerate(RECORDS)]


def test_json_array_is_one_document(spark, tmp_path):
    many = [{"title": str(i), "_h": "x"} for i in range(300)]
    assert writers.write_json(records(spark, many).repartition(7), str(tmp_path / "a"), array=True)
    assert json.loads("".join(parts(tmp_path / "a"))) == [{"title": str(i)} for i in range(300)]
    assert writers.write_json(records(spark, many[:1]), str(tmp_path / "b"), array=True)
    assert json.loads("".join(parts(tmp_path / "b"))) == [{"title": "0"}]


def test_twenty_thousand_keys(spark, tmp_path):
    rows = [{f"k{i:05}": str(i) for i in range(r, 20_000, 4)} for r in range(4)]
    assert writers.write_csv(records(spark, rows), ["k00003"], str(tmp_path / "w"))
    got = list(csv.reader(io.StringIO("".join(parts(tmp_path / "w")), newline="")))
    names = ["k00003", *[f"k{i:05}" for i in range(20_000) if i != 3]]
    assert got == [names, *[[r.get(k, "") for k in names] for r in rows]]
    assert columns.preview(records(spark, rows), ["k00001", "k00000"], ["paper_no"]).columns == ["paper_no", "k00001", "k00000"]


def test_text(spark, tmp_path):
    assert writers.write_text(records(spark), ["title", "b"], str(tmp_path / "t"))
    rule, want = "─" * 60, ""
    for i, r in enumerate(RECORDS, 1):
        want += f"{rule}\nRecord {i}\n{rule}\n" + "".join(f"  {k:<26}: {r.get(k, '')}\n" for k in ORDER) + "\n"
    assert "".join(parts(tmp_path / "t")) == want


def test_no_records_write_nothing(spark, tmp_path):
    none = records(spark).limit(0)
    path = str(tmp_path / "none")
    assert not writers.write_csv(none, ["a"], path) and not writers.write_json(none, path)
    assert not writers.write_text(none, ["a"], path) and not os.path.exists(path)


def test_preview(spark):
    rows = [{"title": "t" * 50, **{f"f{i}": str(i) for i in range(8)}}] + [{"title": str(i)} for i in range(20)]
    fields = ["none", "title", "f0", "f1", "f2", "f3", "f4"]
    shown = columns.preview(records(spark, rows), fields, ["paper_no"])
    assert shown.columns == ["paper_no", "title", "f0", "f1", "f2", "f3"]
    got = shown.collect()
    assert len(got) == 10 and got[0]["title"] == "t" * 38 and got[1]["f0"] == ""


def land(spark, folder, name, rows):
    text = "\n".join(json.dumps({"paper_id": i, "title": t}) for i, t in rows)
    write(folder, name, text)


def test_harvest_keeps_first_arrivals_and_survives_replay(spark, tmp_path):
    pages, table, state = str(tmp_path / "pages"), str(tmp_path / "table"), str(tmp_path / "state")
    schema = "paper_id bigint, title string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(pages)
    land(spark, pages, "1.json", [(5, "One"), (4, " one "), (3, "Two"), (2, ""), (1, None)])
    harvest(stream(), table, state).awaitTermination()
    land(spark, pages, "2.json", [(0, "two"), (9, "Three"), (8, "THREE")])
    harvest(stream(), table, state).awaitTermination()
    land(spark, pages, "3.json", [(7, "one"), (6, "Four")])
    harvest(stream(), table, state).awaitTermination()
    read = lambda: sorted((r["batch_id"], r["paper_id"]) for r in spark.read.parquet(table).collect())
    assert read() == [(0, 3), (0, 4), (1, 8), (2, 6)]
    # the last batch again, as after a failure between its write and its commit
    last = os.path.join(state, "commits", "2")
    os.unlink(last)
    crc = os.path.join(state, "commits", ".2.crc")
    if os.path.exists(crc):
        os.unlink(crc)
    harvest(stream(), table, state).awaitTermination()
    assert read() == [(0, 3), (0, 4), (1, 8), (2, 6)]


def test_page_stream_reports_faults_and_reads_later_pages(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)

    def run(feed, name):
        pages.land_papers(pages.page_stream(spark, folder(name), 2), feed, folder(f"{name}-papers"), folder(f"{name}-errors"),
                          folder(f"{name}-state")).awaitTermination()
        papers_of, faults = (spark.read.parquet(folder(f"{name}-{kind}")).collect() for kind in ("papers", "errors"))
        return sorted(r["paper_id"] for r in papers_of), sorted((os.path.basename(r["ref"]), r["message"]) for r in faults)

    write(folder("atom"), "1.xml", HEAD + ENTRIES + "</feed>")
    write(folder("atom"), "2.xml", HEAD + ENTRIES)
    write(folder("atom"), "3.xml", HEAD + "</feed>")
    write(folder("atom"), "4.xml", "")
    both, cut = ["http://a/1", "http://a/2"], [("2.xml", "malformed page"), ("4.xml", "malformed page")]
    found, faults = run(pages.atom_feed(), "atom")
    assert found == both and faults in (cut, cut[:1])  # a file of no bytes has no row
    write(folder("atom"), "5.xml", HEAD + ENTRIES.replace("http://a/", "http://b/") + "</feed>")
    assert run(pages.atom_feed(), "atom") == ([*both, "http://b/1", "http://b/2"], faults)

    item = {"title": "T", "abstract": "A", "doi": "10.1/x", "date": "2024-01-02"}
    write(folder("json"), "1.json", json.dumps({"collection": [item, {"title": " ", "doi": "10.1/z"}]}))
    write(folder("json"), "2.json", '{"collection": [{"title"')
    write(folder("json"), "3.json", json.dumps({"messages": []}))
    assert run(pages.preprint_feed(F.lit("medRxiv")), "json") == (
        ["https://doi.org/10.1/x"], [("2.json", "malformed page"), ("z", "no title")])
    row = spark.read.parquet(folder("json-papers")).first()
    assert row["server_no"] == 1 and row["feed_pos"]["page_pos"] == 0


@pytest.mark.parametrize("blocks", [1, 1 << 20])
def test_seen_titles_over_many_batches(spark, tmp_path, blocks):
    """Merged tables, deleted folders, batches that run again, and a filter that is far too small."""
    seen = SeenTitles(str(tmp_path / "seen"), buckets=4, blocks=blocks, every=2)
    batches = [["a", "b"], ["b", "c"], [], ["a", "c", "d"], ["e"], ["b", "f"], ["a", "b", "c", "d", "e", "f", "g"]]
    expected = [["a", "b"], ["c"], [], ["d"], ["e"], ["f"], ["g"]]

    def run(n):
        fresh = materialise(seen.unseen(spark.createDataFrame([(t,) for t in batches[n]], "title_key string"), n), "fresh")
        seen.add(fresh, n)
        return sorted(r[0] for r in fresh.collect())

    for n in range(len(batches)):
        assert run(n) == expected[n]
        assert run(n) == expected[n]  # as after a failure before the commit
    left = lambda kind: {os.path.basename(p) for p in glob.glob(str(tmp_path / "seen" / "*" / kind / "*"))}
    # the table merged at batch 4 and what it replaces at 6 stay until batch 7
    assert left("new") == {"batch=4", "batch=5", "batch=6"} and left("whole") == {"batch=4", "batch=6"}
    other = SeenTitles(str(tmp_path / "seen"), buckets=5, blocks=blocks, every=2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        other.unseen(spark.createDataFrame([("a",)], "title_key string"), 7).count()


@pytest.mark.parametrize("delay", [None, "1 day"])
def test_first_arrivals_by_state(spark, tmp_path, delay):
    pages = str(tmp_path / "pages")
    write(pages, "1.json", "\n".join(json.dumps({"title": t, "arrived": "2024-01-01T00:00:00"}) for t in ["A", " a", "B", ""]))
    stream = spark.readStream.schema("title string, arrived timestamp").json(pages)
    name = "arrivals_" + ("plain" if delay is None else "bounded")
    query = (first_arrivals(stream, delay).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r["title_key"] for r in spark.table(name).collect()) == ["a", "b"]


def test_first_by_order_does_not_depend_on_batches(spark, tmp_path):
    """One page, or one page a batch, or a batch anew after a failure before its commit: the same papers in the table."""
    def page(*rows):
        return "\n".join(json.dumps({"paper_id": i, "title": t, "arrived": f"2024-01-{d:02}T00:00:00"}) for i, t, d in rows)

    pages = [
        page((9, "A", 1), (8, " a", 1), (7, "B", 1), (6, "", 1), *[(100 + i, "hot", 1) for i in range(500)]),
        page((1, "a", 2), (5, "C", 2), (4, None, 2)),
        page((3, "A ", 12), (99, "hot", 12)),
        page((0, "end", 25)),
    ]
    schema = "paper_id bigint, title string, arrived timestamp"
    want = [("a", 3), ("a", 8), ("b", 7), ("c", 5), ("hot", 99), ("hot", 100)]

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
        (first_by_order(stream, "3 days").writeStream.format("parquet").option("path", str(tmp_path / f"{name}-table"))
         .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination())
        found = spark.read.parquet(str(tmp_path / f"{name}-table")).collect()
        return sorted((r["title_key"], r["paper_id"]) for r in found)

    write(str(tmp_path / "whole"), "1.json", "\n".join(pages[:3]))
    run("whole")
    write(str(tmp_path / "whole"), "2.json", pages[3])
    assert run("whole") == want
    for n, content in enumerate(pages):
        write(str(tmp_path / "cut"), f"{n}.json", content)
        got = run("cut")
    assert got == want
    commits = str(tmp_path / "cut-state" / "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.unlink(os.path.join(commits, name))
    assert run("cut") == want
    batch = spark.read.schema(schema).json(str(tmp_path / "cut"))
    assert sorted((r["title_key"], r["paper_id"]) for r in first_by_order(batch, "3 days").collect()) == sorted([*want, ("end", 0)])


class Session:
    """Just the parts of a session that decide on the scratch folder."""

    def __init__(self, master, configured):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_scratch_dir_follows_the_session(spark):
    assert scratch_dir(Session("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert scratch_dir(Session("local[2]", "/shared")) == "/shared"
    with pytest.raises(RuntimeError):
        scratch_dir(Session("yarn", None))
    assert scratch_dir(spark) == scratch_dir(spark)


def test_scratch_tables_can_be_released(spark):
    release_scratch(spark)
    table = materialise(spark.range(3), "probe")
    assert table.count() == 3 and release_scratch(spark) == 1 and release_scratch(spark) == 0
    assert not glob.glob(f"{scratch_dir(spark)}/probe-*")


def test_collect_with_responder_and_retries(spark):
    runs = spark.createDataFrame([(1, "", ["title", "year"], 150, 0.92, False), (2, "", ["title"], 150, 0.92, False)],
                                 "run_id bigint, prompt string, fields array<string>, max_papers int, "
                                 "dedup_threshold double, no_preprint boolean")
    meta = "struct<title: string, authors: string, published_date: string, doi: string, url: string, pdf_url: string, categories: string, source: string>"
    blank = ("", "", "", "", "", "", "", "arXiv")
    found = spark.createDataFrame([(1, 1, 10, "u10", "t", blank), (1, 2, 11, "u11", "t", blank), (2, 1, 10, "u10", "t", blank)],
                                  f"run_id bigint, paper_no int, paper_id bigint, url string, text string, meta {meta}")
    answers = spark.createDataFrame(
        [(1, 10, 0, "[]", None), (1, 11, 0, "[]", None),
         (1, 10, 1, '[{"title": "deep nets", "year": 2020}]', None), (1, 11, 1, '[{"title": "Deep Nets", "year": 2020}]', None),
         (1, 10, 2, '[{"title": "late"}]', None), (2, 10, 0, None, "timeout")],
        "run_id bigint, paper_id bigint, attempt int, response string, error string")
    done = collect.collect_records(runs, found, extract.landed_responses(answers))
    assert {(r["run_id"], r["attempt"]) for r in done.chosen.collect()} == {(1, 1), (2, 0)}
    merged = sorted((r["run_id"], r["paper_no"], r["fields"].get("title"), r["fields"].get("year")) for r in done.merged.collect())
    assert merged == [(1, 1, "deep nets", "2020"), (2, 1, None, None)]
    assert [r["message"] for r in done.errors.collect()] == ["Extract u10: timeout"]
    again = collect.collect_records(runs, found, extract.landed_responses(answers), exact=True)
    assert again.merged.where(F.col("run_id") == 1).count() == 2


def test_packs_of_pages_bring_what_page_files_bring(spark, tmp_path):
    """Also a page with line breaks, an empty one and one without text; a pack holds many pages."""
    folder = lambda name: str(tmp_path / name)
    whole = {k: HEAD + ENTRIES.replace("http://a/", f"http://{k}/") + "</feed>" for k in range(150)}
    bodies = whole | {7: HEAD + ENTRIES, 8: "", 9: None, 10: HEAD + "\n\n</feed>"}
    rows = [(f"server=0/page={k}", body) for k, body in bodies.items()]
    pages.write_packs(spark.createDataFrame(rows, "page string, body string").coalesce(1), folder("packs"))
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == 3
    landed = pages.packed_page_stream(spark, folder("packs"), 2)
    pages.land_papers(landed, pages.atom_feed(), folder("papers"), folder("errors"), folder("state")).awaitTermination()
    found = spark.read.parquet(folder("papers")).groupBy("page").count().collect()
    assert {r["page"]: r["count"] for r in found} == {f"server=0/page={k}": 2 for k in bodies if k not in (7, 8, 9, 10)}
    faults = spark.read.parquet(folder("errors")).collect()
    assert sorted(r["ref"] for r in faults) == [f"server=0/page={k}" for k in (7, 8, 9)]
    assert {r["batch_id"] for r in faults} <= {0, 1} and os.path.isdir(folder("papers") + "/batch_id=1")


def test_feed_pages_stand_in_order_of_their_numbers(spark):
    pages = ["/f/10.json", "/f/2.json", "/f/page=3/a.json", "/f/page=20/a.json", "/f/cursor-7-1.json"]
    df = spark.createDataFrame([(p,) for p in pages], "page string")
    got = [r["page"] for r in df.orderBy(preprint.by_number(F.col("page")), "page").collect()]
    assert got == ["/f/2.json", "/f/10.json", "/f/cursor-7-1.json", "/f/page=3/a.json", "/f/page=20/a.json"]


def test_many_columns_meet_their_values_by_position(spark, tmp_path, monkeypatch):
    rows = [{}, {"title": 'a"b', "_x": "no"}, {"z": None, "b": "é,"}, {f"k{i}": str(i) for i in range(9)}]
    shown = []
    for few in (0, 64):
        monkeypatch.setattr(columns, "FEW_COLUMNS", few)
        folder = tmp_path / str(few)
        assert writers.write_csv(records(spark, rows), ["title", "none", "b"], str(folder / "csv"))
        assert writers.write_text(records(spark, rows), ["title", "none", "b"], str(folder / "text"))
        shown.append(["".join(parts(folder / kind)) for kind in ("csv", "text")])
    assert shown[0] == shown[1]
    assert shown[0][0].startswith("title,b," + ",".join(f"k{i}" for i in range(9)) + ",z\r\n" + "," * 11 + "\r\n")
