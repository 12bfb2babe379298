"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct word shingles, as 64-bit hashes. Its signature holds VALUES MinHash
values of 16 bits each. Signatures are split into CHUNKS chunks; by the pigeonhole principle two of
them that differ in at most RADIUS = 2 * CHUNKS - 1 values differ in at most one value within some chunk. So every
chunk is indexed once for each value left out, and two signatures within the radius share a key for sure. At a
similarity of exactly 0.8 signatures lie outside the radius with a probability of about 1 in 10,000, and far
less above it.

The radius also admits pairs down to a similarity of about 0.6. A profile refuses most of them: the set's hashes fall into
BINS bins, and the profile holds 8 bits of the smallest hash of each. Only classes that share a key get one. The share of equal bins among those that either
set fills estimates the similarity; the fewer of the two sets' hashes share a bin, the closer. Pairs whose estimate lies more
than SIGMAS standard deviations below the limit are refused, which loses about 3 in 100,000 of those exactly at it.

Documents with equal sets form a class; one stands for all. Keys that several classes share give candidates. First
each class meets the smallest and the largest of the classes that lead its keys (so a group of near copies sends no list of
pairs), they are confirmed on full sets, and links are joined to components. Then keys whose
classes still lie in different components are compared in blocks by signature and profile. Keys with the same classes are
compared once, and a pair is reported only by the group of its first common key, so once. Only candidates between
different components are confirmed, the closest first and all others after that. So every
link between components is found, but links within a component need not be.

Defined cases: a null text, or one without words, has an empty set, is linked with nothing and is
its own component. Rows are documents: repeated rows are copies of each other. A null id names
no component as long as another id is there, and its ``kept`` is false. Where ids are repeated, the filter keeps the
first of the rows with the smallest id, by a hash of the whole row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.blocks import allowed_pairs, block_pairs, map_groups
from paperlake.llm.common import col, fresh
from paperlake.llm.components import components
from paperlake.session import materialise, sized_side

#: Chunks of a signature, values of a chunk, values of a signature.
CHUNKS, CHUNK = 14, 5
VALUES = CHUNKS * CHUNK
#: Largest distance of two signatures whose pairs are all found, with one error allowed in a chunk.
RADIUS = 2 * CHUNKS - 1
WORDS, PERCENT = 5, 80
#: Bins of a profile, and standard deviations of its estimate within which a pair is confirmed.
BINS, SIGMAS = 1024, 4
#: Candidates per class and group that a round confirms; None: all.
ROUNDS = (1, None)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Remembered word hashes of a Python worker.
REMEMBERED = 500_000
_words: dict[bytes, int] = {}


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    new = set(words).difference(_words)
    _words.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(words))], np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k:len(words) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(5)
_FACTORS = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_TERMS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> bytes:
    """The lowest 16 bits of each MinHash value, after mixing. Values are 32 bits wide, which numpy
    multiplies many at a time."""
    short = ((shingles * _MIX) >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(short), 1024):
        mixed = short[None, s:s + 1024] * _FACTORS
        mixed ^= mixed >> np.uint32(15)
        mixed += _TERMS
        low = np.minimum(low, mixed.min(axis=1))
    low = low * np.uint32(0x9E3779B1)
    return (low ^ (low >> np.uint32(16))).astype(">u2").tobytes()


def profile(shingles: np.ndarray) -> bytes:
    """For each bin, 0 if no hash falls into it, else 1 to 255 from the smallest one."""
    out = np.zeros(BINS, np.uint8)
    back = shingles[::-1]  # the smallest hash of a bin is written last
    out[(back * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BINS.bit_length())] = 1 + ((back * _MIX) >> np.uint64(33)) % np.uint64(255)
    return out.tobytes()


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether pairs of profiles may be similar enough, their estimated similarity).

    A bin tells whether one hash of the union, drawn without replacement, lies in both sets, so of a union hardly larger
    than the number of filled bins the estimate is nearly exact.
    """
    limit = percent / 100
    filled = np.maximum(((a | b) != 0).sum(axis=1), 1)
    same = ((a == b) & (a != 0)).sum(axis=1) / filled
    union = np.maximum((na + nb) / (1 + limit), filled + 1)
    # 255 values: unequal hashes look the same once in 255 times, so estimates err upwards only
    spread = np.sqrt(limit * (1 - limit) / filled * (1 - filled / union) + 0.25 / filled ** 2)
    return same >= limit - SIGMAS * spread, same


def sketches(docs: DataFrame, id: str, text: str, size: int, *more: Column) -> DataFrame:
    """(doc_id, more columns, n, h1, h2, signature): size and 128-bit hash of every set."""
    slim = docs.select(col(id).alias("doc_id"), *more, col(text).alias("text"))
    rest = slim.drop("text")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, h1, h2, signs = [], [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), size)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                ns.append(len(s))
                h1.append(int.from_bytes(digest[:8], "big", signed=True))
                h2.append(int.from_bytes(digest[8:], "big", signed=True))
                signs.append(signature(s) if len(s) else None)
            added = {"n": pa.array(ns, pa.int64()), "h1": pa.array(h1, pa.int64()),
                     "h2": pa.array(h2, pa.int64()), "signature": pa.array(signs, pa.binary())}
            kept = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(kept | added)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema)
    return slim.mapInArrow(run, f"{schema}, n bigint, h1 bigint, h2 bigint, signature binary")


def keys(signs: Column) -> Column:
    """Index keys of a signature: every chunk without one of its values, hashed with its place."""
    out = []
    for c in range(CHUNKS):
        for d in range(CHUNK):
            at = 2 * CHUNK * c + 1
            rest = F.concat(
                F.substring(signs, at, 2 * d), F.substring(signs, at + 2 * d + 2, 2 * (CHUNK - 1 - d))
            )
            out.append(F.xxhash64(F.lit(c * CHUNK + d), rest))
    return F.array(*out)


def first_shared(differ: np.ndarray) -> np.ndarray:
    """Place of the first common key of pairs, from (pairs, VALUES) of which values differ; CHUNKS * CHUNK if none.

    A chunk with one error is shared by the key that leaves this value out, one without error by all its keys.
    """
    chunks = differ.reshape(len(differ), CHUNKS, CHUNK)
    errors = chunks.sum(axis=2)
    fit = errors <= 1
    at = fit.argmax(axis=1)
    row = np.arange(len(differ))
    place = at * CHUNK + np.where(errors[row, at] == 1, chunks[row, at].argmax(axis=1), 0)
    return np.where(fit.any(axis=1), place, CHUNKS * CHUNK)


def _arrays(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    signs = np.frombuffer(b"".join(group["signature"]), ">u2").astype(np.uint16).reshape(-1, VALUES)
    return signs, np.frombuffer(b"".join(group["profile"]), np.uint8).reshape(-1, BINS)


PAIR = "a bigint, b bigint, est double, cut int"


def _near(limit: int | None, percent: int):
    """Candidates of one group: pairs within the radius whose components differ, whose profiles allow it, and whose
    first common key is one of the group's; the ``limit`` closest partners of every row, ties by class, and whether others were left."""

    def work(group: pd.DataFrame) -> pd.DataFrame | None:
        left, right = allowed_pairs(group)
        same = group["i"].iloc[0] == group["j"].iloc[0]
        comp, cid, n = (group[c].to_numpy() for c in ("comp", "cid", "n"))
        mask = int(group["low"].iloc[0]) | int(group["high"].iloc[0]) << 35
        signs, forms = _arrays(group)
        own = np.array([mask >> p & 1 for p in range(VALUES + 1)], bool)
        out = []
        for s in range(0, len(left), 64):
            at = left[s:s + 64]
            fine = comp[at][:, None] != comp[right][None, :]
            if same:
                fine &= at[:, None] < right[None, :]
            if not fine.any():
                continue
            fine &= (signs[at][:, None, :] != signs[right][None, :, :]).sum(axis=2) <= RADIUS
            x, y = np.nonzero(fine)
            for e in range(0, len(x), 5_000):
                p, q = at[x[e:e + 5_000]], right[y[e:e + 5_000]]
                first = own[first_shared(signs[p] != signs[q])]
                p, q = p[first], q[first]
                good, est = likely(forms[p], forms[q], n[p], n[q], percent)
                out.append((p[good], q[good], est[good]))
        if not sum(len(p) for p, _, _ in out):
            return None
        a, b, est = (np.concatenate(p) for p in zip(*out, strict=True))
        pairs = pd.DataFrame({"a": np.minimum(cid[a], cid[b]), "b": np.maximum(cid[a], cid[b]), "est": est, "cut": 0})
        if limit is None:
            return pairs
        pairs = pairs.sort_values(["est", "a", "b"], ascending=[False, True, True])
        rank = np.minimum(pairs.groupby("a").cumcount(), pairs.groupby("b").cumcount())
        return pairs[rank < limit].assign(cut=int((rank >= limit).any()))

    return work


def _near_two(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates of the groups of two classes; ``rows`` as for ``_near``."""
    both = rows.groupBy("key", "low", "high").agg(
        *[f(F.struct("cid", "n", "signature", "profile")).alias(c) for f, c in ((F.min, "x"), (F.max, "y"))]
    )
    wide = both.select("low", "high", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in "xy" for f in ("cid", "n", "signature", "profile")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            (sx, fx), (sy, fy) = (_arrays(batch[[f"{c}_signature", f"{c}_profile"]].set_axis(["signature", "profile"], axis=1)) for c in "xy")
            differ = sx != sy
            place = first_shared(differ)
            low, high = batch["low"].to_numpy(), batch["high"].to_numpy()
            own = np.where(place < 35, low >> np.minimum(place, 34), high >> np.clip(place - 35, 0, 34)) & 1
            good, est = likely(fx, fy, batch["x_n"].to_numpy(), batch["y_n"].to_numpy(), percent)
            good &= (differ.sum(axis=1) <= RADIUS) & (own == 1) & (place < VALUES)
            yield pd.DataFrame({"a": batch["x_cid"][good], "b": batch["y_cid"][good], "est": est[good], "cut": 0})

    return wide.mapInPandas(run, PAIR)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough. Pairs arrive sorted by ``a``, so
    the set of a class with many partners is made once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            hit = []
            for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, kept = a, shingle_set(ta, size)
                other = shingle_set(tb, size)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                hit.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield batch.loc[hit, ["a", "b"]]

    first = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    wide = pairs.select("a", "b").join(second.hint("merge"), "b").join(first.hint("merge"), "a")
    return wide.mapInPandas(run, "a bigint, b bigint")


def _texts(docs: DataFrame, wanted: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(cid, text, profile) of the wanted classes, by the id and a hash of the text of one of their rows."""
    d = docs.select(
        F.coalesce(F.hash(col(id)), F.lit(0)).alias("hid"), F.xxhash64(col(text)).alias("htext"), col(text).alias("text")
    )
    joined = d.join(sized_side(wanted.select("hid", "htext", "cid")), ["hid", "htext"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([profile(shingle_set(t.as_py(), size)) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_pydict({"cid": batch.column("cid"), "text": batch.column("text"), "profile": forms})

    once = joined.select("cid", "text").dropDuplicates(["cid"])
    return materialise(once.mapInArrow(run, "cid bigint, text string, profile binary"), "near-texts")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: only the components that these join are gone through again."""
    for c in ("a", "b"):
        links = links.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    between = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    higher = components(between).select(F.col("id").alias("root"), F.col("root").alias("top"))
    both = roots.join(higher, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    alone = higher.join(roots.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("top").alias("root"))
    return materialise(both.union(alone), "roots")


def near_classes(docs: DataFrame, id: str, text: str, size: int, percent: int, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, classes with their component's root)."""
    rows = materialise(
        sketches(docs, id, text, size, F.coalesce(F.hash(col(id)), F.lit(0)).alias("hid"),
                 F.xxhash64(col(text)).alias("htext"), *more),
        "sketches",
    )
    classes = (
        rows.where("n > 0").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("doc_id"), F.max("signature").alias("signature"),
             F.min(F.struct("hid", "htext")).alias("row"), F.max("n").alias("n"))
        .select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "doc_id", "n", "signature", "row.hid", "row.htext")
    )
    classes = materialise(classes, "classes")
    index = classes.select("cid", F.posexplode(keys(F.col("signature"))).alias("place", "key"))
    shared = index.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("most")).where("hub < most")
    members = materialise(index.join(shared.select("key", "hub"), "key"), "members")
    hubs = members.where("cid <> hub").groupBy(F.col("cid").alias("b")).agg(F.min("hub").alias("x"), F.max("hub").alias("y"))
    tried = materialise(hubs.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"), "tried")
    involved = members.select("cid").distinct()
    texts = _texts(docs, classes.join(involved, "cid").select("hid", "htext", "cid"), id, text, size)
    signs = materialise(classes.select("cid", "n", "signature").join(texts.select("cid", "profile"), "cid"), "near-signs")
    links = materialise(_confirmed(tried, texts, size, percent), "near-links")
    roots = components(links)
    for limit in ROUNDS:
        placed = members.select("key", "place", "cid").join(roots.withColumnRenamed("id", "cid"), "cid", "left").select(
            "key", "place", "cid", F.coalesce("root", "cid").alias("comp")
        )
        bit = lambda p: F.expr(f"shiftleft(1L, {p})")
        mixed = placed.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many"), F.min("place").alias("place"),
            F.sum(F.xxhash64("cid") % (1 << 40)).alias("h1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("h2"),
        ).where("lo < hi")
        mixed = mixed.groupBy("many", "h1", "h2").agg(
            F.min("key").alias("key"), F.bit_or(F.when(F.col("place") < 35, bit("place")).otherwise(0)).alias("low"),
            F.bit_or(F.when(F.col("place") >= 35, bit("place - 35")).otherwise(0)).alias("high"),
        ).select("key", "many", "low", "high")
        open_rows = placed.drop("place").join(mixed, "key").join(signs, "cid").select(
            "key", "many", "low", "high", "cid", "comp", "n", "signature", "profile"
        )
        open_rows = materialise(open_rows, "near-open")
        blocks = block_pairs(open_rows.where("many > 2").withColumnRenamed("n", "size").withColumnRenamed("many", "n"))
        found = map_groups(blocks.withColumnRenamed("size", "n"), _near(limit, percent), PAIR)
        found = found.union(_near_two(open_rows.where("many = 2"), percent))
        found = materialise(found.groupBy("a", "b").agg(F.max("cut").alias("cut")), "near-candidates")
        new = materialise(found.join(tried, ["a", "b"], "left_anti").select("a", "b"), "near-new")
        if not new.isEmpty():
            links = materialise(_confirmed(new, texts, size, percent), "near-links")
            tried = materialise(tried.union(new), "tried")
            roots = _joined(roots, links)
        if found.where("cut > 0").isEmpty():  # these were all candidates, and joining components adds none
            break
    placed = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select(
        "h1", "h2", "doc_id", F.coalesce("root", "cid").alias("root")
    )
    return rows, placed


def near_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept)."""
    rows, placed = near_classes(docs, id, text, size, percent)
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.drop("doc_id").join(names, "root").drop("root")
    root = F.when(F.col("n") > 0, F.col("component_id"))
    return rows.join(named, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(root, "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce(root, "doc_id"), F.lit(False)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id, then row hash. Rows
    without words stay; of identical ones, the first."""
    whole = F.xxhash64(*[col(c) for c in docs.columns])
    rows, placed = near_classes(docs, id, text, size, percent, whole.alias("hrow"))
    lone = F.when(F.col("n") == 0, F.col("hrow"))
    joined = rows.join(placed.select("h1", "h2", "root"), ["h1", "h2"], "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hrow")).alias("first")
    chosen = joined.groupBy("root", lone.alias("lone")).agg(first).select(
        F.col("first.hrow").alias("hrow"), F.coalesce(F.hash("first.doc_id"), F.lit(0)).alias("hid")
    )
    h_row, h_id, many = fresh(docs, "hrow", "hid", "many")
    counts = rows.groupBy("hrow", "hid").agg((F.count("*") > 1).alias("many"))
    chosen = materialise(chosen.distinct().join(counts, ["hrow", "hid"]), "near-chosen").select(
        F.col("hrow").alias(h_row), F.col("hid").alias(h_id), F.col("many").alias(many)
    )
    marked = docs.withColumns({h_row: whole, h_id: F.coalesce(F.hash(col(id)), F.lit(0))})
    kept = marked.join(sized_side(chosen), [h_row, h_id])
    once = kept.where(~col(many)).union(kept.where(col(many)).dropDuplicates([h_row, h_id]))
    return once.select(*[col(c) for c in docs.columns])
