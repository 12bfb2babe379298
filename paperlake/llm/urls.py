"""URL filters: explicit rules, and a logistic regression for the rest.

Rules are (host, path) pairs; a rule fits its host and all subdomains where the path starts with the
rule's, and the longest one wins. URLs without a rule are judged by a logistic regression on hashed
character n-grams of host and path. It is trained on a small table of labelled URLs, of which a
bounded sample in hash order is used (``max_labelled``); the weights, one number per hash slot, are
broadcast and have a fixed size.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets
the model's verdict for empty text. Rows are judged one by one, so repeated rows, null ids and foreign
columns do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.common import col

#: Slots of the hashed n-grams and their lengths.
SLOTS, GRAMS = 1 << 16, (3, 4, 5)
#: Most labelled URLs used in training.
MAX_LABELLED = 20_000
#: Rules (fixed values): verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Parts of host names from which the labelled table is built: every first one with every last one. There are more
#: good hosts than bad ones, so a host that resembles neither is allowed.
BAD_PARTS = (
    ("cheap", "free", "spam", "discount", "instant", "lucky", "mega", "bonus", "miracle", "payday"),
    ("casino", "poker", "lotto", "pharmacy", "loans", "cams", "keygen", "replicas", "jackpot", "slots"),
)
GOOD_PARTS = (
    ("city", "north", "royal", "county", "open", "national", "old", "river", "central", "modern", "state", "harbour",
     "family", "rural", "public", "alpine"),
    ("library", "museum", "gazette", "archive", "garden", "weather", "journal", "theatre", "council", "hospital",
     "railway", "observatory", "orchestra", "bakery", "forum", "university"),
)
DOMAINS = ("example.com", "example.org", "example.net")
PLACES = ("/", "/en/12", "/de/417.html", "/fr/83/", "/es/205?page=2")


@dataclass(frozen=True)
class Model:
    """Weights of the hash slots and the intercept."""

    weights: np.ndarray
    intercept: float


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.char_length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null without one. Ties go to the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last one that fits stands
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def labelled_urls(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A small labelled table (url, bad): the Parquet table at ``path``, or hosts made of the parts, with three
    addresses each that go through the domains, paths and prefixes in turn."""
    if path is not None:
        return spark.read.parquet(path).select("url", "bad")
    rows = []
    for bad, (firsts, lasts) in ((1, BAD_PARTS), (0, GOOD_PARTS)):
        for i, first in enumerate(firsts):
            for j, last in enumerate(lasts):
                for k, domain in enumerate(DOMAINS):
                    host = f"{('', 'www.', 'm.', 'blog.')[(i + k) % 4]}{first}{('-', '')[(i + j) % 2]}{last}.{domain}"
                    rows.append((f"https://{host}{PLACES[(i + j + k) % len(PLACES)]}", bad))
    return spark.createDataFrame(rows, "url string, bad int")


def slots(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all n-grams of texts, and the text of each.

    The UTF-8 bytes of a batch are hashed in one sweep; n-grams that reach into the next text drop out.
    """
    data = [("^" + t + "$").encode() for t in texts]
    row = np.repeat(np.arange(len(data)), [len(d) for d in data])
    chars = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
    found, of = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ chars[k:len(chars) - n + 1 + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        whole = row[:len(h)] == row[n - 1:]
        found.append((h[whole] % np.uint64(SLOTS)).astype(np.int64))
        of.append(row[:len(h)][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def _sums(model: Model, texts: Sequence[str]) -> np.ndarray:
    slot, row = slots(texts)
    counts = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    return np.bincount(row, model.weights[slot], minlength=len(texts)) / np.sqrt(counts) + model.intercept


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED, url: str = "url", bad: str = "bad",
          rounds: int = 300, step: float = 2.0, decay: float = 1e-4) -> Model:
    """Logistic regression by gradient descent on at most ``max_labelled`` labelled URLs."""
    host, path = host_path(col(url))
    rows = (
        labelled.where(col(url).isNotNull() & col(bad).isNotNull())
        .select(F.concat(host, path).alias("t"), col(bad).cast("int").alias("y"))
        .orderBy(F.xxhash64("t"), "t", "y").limit(max_labelled).toPandas()
    )
    w, b = np.zeros(SLOTS), 0.0
    if not len(rows):
        return Model(w, b)
    slot, row = slots(list(rows["t"]))
    counts = np.maximum(np.bincount(row, minlength=len(rows)), 1)
    scale = 1.0 / np.sqrt(counts)
    y = rows["y"].to_numpy(float)
    for _ in range(rounds):
        z = np.bincount(row, w[slot], minlength=len(rows)) * scale + b
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= step * (np.bincount(slot, (error * scale)[row], minlength=SLOTS) + decay * w)
        b -= step * error.sum()
    return Model(w, float(b))


def judged(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES, id: str = "page_id",
           url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else the model's."""
    host, path = host_path(col(url))
    slim = pages.select(col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = best_rule(F.col("host"), F.col("path"), rules)
    sent = pages.sparkSession.sparkContext.broadcast(
        Model(model.weights.astype(np.float32), model.intercept)
    )

    @F.pandas_udf("double")
    def score(hosts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in hosts:
            yield pd.Series(1 / (1 + np.exp(-_sums(sent.value, list(h + p)))))

    scored = slim.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"),
                         score("host", "path").alias("score"))
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
