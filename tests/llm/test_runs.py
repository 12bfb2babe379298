"""Periodic runs against a search through all periods."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperlake.llm import runs


def brute(ws, exponent=4, least=6):
    """All runs: maximal stretches for every period, those with a smaller period left out."""
    n, out = len(ws), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and ws[i] == ws[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(least, exponent * q):
                smaller = any(all(ws[k] == ws[k + p] for k in range(s, s + size - p)) for p in range(1, q))
                if not smaller:
                    out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 3), (2, 5)])
def test_runs_of_random_words(exponent, least):
    rng = random.Random(exponent * 10 + least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 30])
            ws = [b"%d" % rng.randint(0, k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a = rng.randint(0, n - 1)
                p = 1 + (n - a) // rng.randint(3, 10)
                ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
            docs.append(ws)
        assert runs.word_runs(docs, exponent, least) == [brute(d, exponent, least) for d in docs]


def test_repeats_are_cut_to_one_period():
    ws = b"x a b a b a b a b y z z z z z z z".split()
    found = runs.word_runs([ws])[0]
    assert found == [(1, 8, 2), (10, 7, 1)]
    assert runs.collapsed(ws, found) == b"x a b y z"


def test_long_run():
    assert runs.word_runs([[b"a"] * 50_000, [b"a", b"b"] * 30_000])[:2] == [[(0, 50_000, 1)], [(0, 60_000, 2)]]


def test_rows(spark, odd, empty):
    found = runs.periodic_runs(odd)
    rows = {(r["doc_id"], r["n_words"]): r for r in found.collect()}
    assert found.count() == odd.count() and runs.run_digest(runs.periodic_runs(empty)).count() == 0
    for r in odd.collect():
        ws = (r["text"] or "").encode().split()
        got = rows[r["doc_id"], len(ws)]
        if len(ws) < 5000:
            want = brute(ws)
            assert [tuple(x) for x in got["runs"]] == want
            assert got["collapsed"] == runs.collapsed(ws, want).decode()
    digest = {r["doc_id"]: r for r in runs.run_digest(found).collect()}
    assert digest[1]["n_runs"] == 0 and digest[1]["start"] is None
    assert digest[1]["runs_sha256"] == digest[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_best_run_and_hashes(spark):
    text = "a a a a a a b c b c b c b c b c b c d d d d d d e f e f e f e f"
    row = runs.run_digest(runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    # 6 periods: a (0, 6, 1), b c (6, 12, 2), d (18, 6, 1); 4 periods: e f (24, 8, 2)
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (4, 0, 6, 1, 6000)
    assert row["runs_sha256"] == hashlib.sha256(b"0,6,1\n6,12,2\n18,6,1\n24,8,2\n").hexdigest()
    assert row["collapsed_sha256"] == hashlib.sha256(b"a b c d e f").hexdigest()


def test_rewritten(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(200)] + [(None, "a b c"), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", runs.rewritten(F.col("doc_id"), F.col("text")).alias("new")).collect()
    changed = 0
    for r in got:
        h = zlib.crc32(str(r["doc_id"]).encode())
        ws = (r["text"] or "").split()
        n, g = len(ws), h // 10
        if r["doc_id"] is not None and h % 10 == 0:
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
            changed += r["new"] != r["text"]
        assert (r["new"] or "").split() == ws
    assert changed > 3
