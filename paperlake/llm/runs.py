"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a stretch of consecutive words with smallest period q, at least ``EXPONENT`` periods and ``MIN_WORDS``
words long, that no neighbouring word extends keeping that period.

The suffixes of a document's words are sorted by prefix doubling; only suffixes that are still tied are sorted again,
and many documents are sorted together, each apart from the others. Neighbours in this order are edges
weighted by their longest common prefix (LCP). Kruskal takes them by falling LCP and unites classes of suffixes with
union-find; each class keeps its positions in order, and the smaller class moves into the larger one. Positions i
and i + d that become neighbours within a class at LCP l agree in l words, so the words i to i + d + l have period d: a
seed, if l >= (EXPONENT - 1) * d. It is a run if the word before i doesn't prolong it.

Each run is found once and nothing else is: in a run of start s, end e and smallest period q the LCP of s and
s + q is e - s - q exactly, so they meet at that level and no other; a position of their class between them
would give the run a smaller period. If d were not the smallest period q of a seed, i and i + q would have met
at a higher LCP and i + d would not be next to i. As l >= (EXPONENT - 1) * d and l + d >= MIN_WORDS bound l from below,
Kruskal stops there and most texts need no union at all.

Defined cases: a null text, or one without words, has no runs and collapses to an empty text. Rows are
documents; repeated rows give repeated results, and a null id is kept. Texts are read whole; a task holds the
suffixes of about BATCH words or of one longer text. Foreign columns are kept only if named. An empty table gives no
rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import col, let, words

EXPONENT, MIN_WORDS = 4, 6
#: Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH = 1 << 18


def least_lcp(exponent: int, min_words: int) -> int:
    """Smallest LCP of two positions that can seed a run."""
    return max(exponent - 1, -(-min_words * (exponent - 1) // exponent), 1)


def edges(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(LCP, position, position) of neighbours in suffix order whose LCP is ``least`` or more, by falling LCP.

    ``ids`` numbers the words of several documents; ``ends`` holds for each word where its document ends. The
    ranks of each doubling are kept, to find an LCP exactly by steps of falling powers of two.
    """
    n = len(ids)
    key = ends * (int(ids.max(initial=0)) + 1) + ids
    active = np.argsort(key, kind="stable")
    slots = np.arange(n)
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    group, second, h = ends[active], ids[active], 0
    while len(active):
        new = np.ones(len(active), bool)
        same = group[1:] == group[:-1]
        new[1:] = ~same | (second[1:] != second[:-1])
        if 2 * h > least:
            cut = np.flatnonzero(same & new[1:])
            found.append((np.full(len(cut), h), active[cut], active[cut + 1]))
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[active] = first
        levels.append(rank.astype(np.int32))
        alone = new & np.append(new[1:], True)
        active, slots, group = active[~alone], slots[~alone], first[~alone]
        h = max(1, 2 * h)
        far = active + h
        inside = far < ends[active]
        second = np.full(len(active), -1)
        second[inside] = rank[far[inside]]
        order = np.lexsort((second, group))
        active, second = active[order], second[order]
        group = group[order]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    lcp, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    for k in range(len(levels) - 1, -1, -1):
        # a pair split at h has its LCP in [h, 2h), so only smaller powers of two are added to it
        i, j = a + lcp, b + lcp
        at = np.flatnonzero((lcp & ((2 << k) - 1) == 0) & (i < ends[a]) & (j < ends[b]))
        at = at[levels[k][i[at]] == levels[k][j[at]]]
        lcp[at] += 1 << k
    big = lcp >= least
    lcp, a, b = lcp[big], a[big], b[big]
    order = np.argsort(-lcp, kind="stable")
    return lcp[order], a[order], b[order]


def kruskal(lcp: list[int], a: list[int], b: list[int], exponent: int) -> list[tuple[int, int, int]]:
    """Seeds (position, distance, LCP) of the classes united edge by edge."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds = []

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for l, x, y in zip(lcp, a, b, strict=True):
        x, y = find(x), find(y)
        large, small = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y] = x
        most, last = l // (exponent - 1), len(small) - 1
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at and p - large[at - 1] <= most and (not k or small[k - 1] < large[at - 1]):
                seeds.append((large[at - 1], p - large[at - 1], l))
            if at < len(large) and large[at] - p <= most and (k == last or small[k + 1] > large[at]):
                seeds.append((p, large[at] - p, l))
        if len(small) * 16 < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
        members[x] = large
    return seeds


def word_runs(texts: list[list[bytes]], exponent: int = EXPONENT, min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    numbers: dict[bytes, int] = {}
    for t in texts:
        for w in set(t).difference(numbers):
            numbers[w] = len(numbers)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, len(ends))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = edges(ids, ends, least_lcp(exponent, min_words))
    seeds = kruskal(*(x.tolist() for x in found), exponent)
    if seeds:
        starts = np.cumsum(sizes) - sizes
        i, d, l = np.array(seeds, np.int64).T
        doc = np.searchsorted(starts, i, "right") - 1
        grows = (i > starts[doc]) & (ids[i - 1] == ids[i + d - 1])
        keep = ~grows & (l + d >= min_words)
        for t, s, n, q in zip(doc[keep].tolist(), (i - starts[doc])[keep].tolist(), (l + d)[keep].tolist(), d[keep].tolist(), strict=True):
            runs[t].append((s, n, q))
    for r in runs:
        r.sort(key=lambda x: (x[0], x[2]))
    return runs


def collapsed(ws: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, each run cut to its first period."""
    if runs:
        drop = np.zeros(len(ws) + 1, np.int64)
        for s, n, q in runs:
            drop[s + q] += 1
            drop[s + n] -= 1
        ws = [w for w, d in zip(ws, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
    return b" ".join(ws)


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str | Column = "text", exponent: int = EXPONENT,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each whole text, by start and period, and the text without
    their repetitions."""
    slim = docs.select(col(id).alias("doc_id"), (col(text) if isinstance(text, str) else text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = word_runs(texts, exponent, min_words)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.concat_arrays(ids), "n_words": pa.array([len(t) for t in texts], pa.int64()),
            "runs": pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], run_type),
            "collapsed": pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
        })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                ws = (column[k].as_py() or b"").split()
                if texts and held + len(ws) > BATCH:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(batch.column("doc_id").slice(k, 1))
                texts.append(ws)
                held += len(ws)
        if texts:
            yield done(ids, texts)

    return slim.mapInArrow(work, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """Digest columns of ``periodic_runs``: number of runs, the most repeated one, hashes of runs and text.

    The most repeated run has the greatest exact length / period, then the smallest start, then period: a later
    run of the list replaces the best one only if it is repeated more.
    """
    best = F.reduce(
        "runs", F.get("runs", F.lit(0)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rewritten(id: Column, text: Column) -> Column:
    """The text in which, for about a tenth of the ids, the words from a place on repeat with a period."""
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")

        def at(place: Column) -> Column:
            a, p = place["a"], place["p"]
            return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int"))))

        a = g % n
        place = F.struct(a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).alias("p"))
        return F.when(n > 0, F.array_join(let(place, at), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words(text), repeat)).otherwise(text)
