import random

from pyspark.sql import functions as F

from paperlake.operators.ranking import first_wins, number_rows, prefix_cap


def rows(spark, n=500, seed=5):
    rng = random.Random(seed)
    data = [(0 if rng.random() < 0.4 else rng.randrange(6), rng.randrange(50), i) for i in range(n)]
    return data, spark.createDataFrame(data, "k int, score int, id bigint").repartition(6)


def test_first_wins(spark):
    data, df = rows(spark)
    want = {}
    for k, s, i in sorted(data, key=lambda r: (r[1], r[2])):
        want.setdefault(k, i)
    once = first_wins(df, ["k"], ["score", "id"])
    assert {r["k"]: r["id"] for r in once.collect()} == want
    assert {r["k"]: r["id"] for r in first_wins(once, ["k"], ["score", "id"]).collect()} == want


def test_prefix_cap_is_a_prefix_with_and_without_salt(spark):
    data, df = rows(spark)
    df = df.withColumn("cap", F.col("k") * 10 + 5)
    for cap, limit in ((7, lambda k: 7), (2000, lambda k: 2000), (F.col("cap"), lambda k: 10 * k + 5)):
        got = {}
        for r in prefix_cap(df, ["k"], [F.desc("score"), "id"], cap, rank_name="no", salts=4).collect():
            got.setdefault(r["k"], []).append((r["no"], r["id"]))
        for k, found in got.items():
            full = sorted((r for r in data if r[0] == k), key=lambda r: (-r[1], r[2]))
            assert sorted(found) == [(n + 1, r[2]) for n, r in enumerate(full[: limit(k)])]
    pruned = prefix_cap(df, ["k"], ["id"], F.col("cap"), most=55)
    salted = prefix_cap(df, ["k"], ["id"], F.col("cap"))
    assert sorted(pruned.collect()) == sorted(salted.collect())


def test_small_caps_are_pruned_before_the_shuffle(spark):
    _, df = rows(spark)
    plan = prefix_cap(df, ["k"], ["id"], 7)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = first_wins(df, ["k"], ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_number_rows(spark):
    data, df = rows(spark)
    got = {}
    for r in number_rows(df, ["k"], ["score", "id"]).collect():
        got.setdefault(r["k"], []).append((r["record_no"], r["id"]))
    for k, found in got.items():
        full = sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))
        assert sorted(found) == [(n + 1, r[2]) for n, r in enumerate(full)]
