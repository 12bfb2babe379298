"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Identical vectors of a label form one class. Each class gets ``tables`` signatures of ``bits`` signs;
classes that share label, length and one signature are compared, by the cosine in double precision.
``bits`` grows with the logarithm of the largest label, so that chance collisions stay few, and the
number of tables follows from the wanted recall at the threshold: two vectors at angle t agree in a sign
with probability 1 - t / pi, so they miss all tables with probability (1 - (1 - t / pi) ^ bits) ^ tables,
at most 1 - RECALL at the threshold itself and less above it. A pair is counted in the first table
in which it meets. Within a bucket rows are compared in blocks; a block pair returns the number of
links of each row and one edge per row to the smallest row it is connected with there, so groups of near copies
send no list of pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows whose
label is null, link with nothing; vectors of different lengths never link. Identical rows, repeated
ids included, are different vectors that link with each other. A null id takes part, but names no component
as long as another id is there; its ``kept`` is false. An empty table gives no rows. Foreign columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.blocks import allowed_pairs, block_pairs, map_groups
from paperlake.llm.common import col
from paperlake.llm.components import components
from paperlake.session import materialise

THRESHOLD = 0.98
#: Least probability with which a pair exactly at the threshold meets in some table.
RECALL = 0.9999
#: Signs beyond the logarithm of the largest label; bounds of a signature's length.
EXTRA_BITS, MIN_BITS, MAX_BITS = 4, 8, 32


def parameters(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs per table and number of tables for a largest label of so many rows."""
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(largest, 2))) + EXTRA_BITS))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _signatures(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``rows`` (cid, label, vector, n) with the vector as bytes of doubles and its packed signatures."""
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in batch["vector"]]
            signs: list[bytes] = [b""] * len(vectors)
            for d in {len(v) for v in vectors}:
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                up = (np.stack([vectors[i] for i in at]) @ planes[d] > 0).reshape(len(at), tables, bits)
                packed = (up.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64).astype(">u4")
                for i, p in zip(at, packed, strict=True):
                    signs[i] = p.tobytes()
            yield pd.DataFrame({
                "cid": batch["cid"], "label": batch["label"], "dim": [len(v) for v in vectors],
                "n": batch["n"], "vec": [v.astype(np.float32).tobytes() if (v == v.astype(np.float32)).all()
                                         else v.tobytes() for v in vectors],
                "signs": signs,
            })

    return rows.mapInPandas(run, "cid bigint, label string, dim int, n bigint, vec binary, signs binary")


def _links(threshold: float):
    """Links within one group of a bucket."""

    def work(group: pd.DataFrame) -> pd.DataFrame | None:
        kinds = ["label", "tab", "dim"]
        if any((group[c] != group[c].iloc[0]).any() for c in kinds):  # keys are hashes and may collide
            parts = [work(part) for _, part in group.groupby(kinds)]
            parts = [p for p in parts if p is not None]
            return pd.concat(parts) if parts else None
        left, right = allowed_pairs(group)
        same = group["i"].iloc[0] == group["j"].iloc[0]
        if not len(left) or not len(right) or (same and len(left) < 2):
            return None
        table, dim = int(group["tab"].iloc[0]), int(group["dim"].iloc[0])
        vec = group["vec"].to_numpy()
        x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64)
                      for v in vec])
        norm = np.sqrt((x * x).sum(axis=1))
        cos = (x[left] @ x[right].T) / np.outer(norm[left], norm[right])
        near = cos >= threshold
        if same:
            near = np.triu(near, 1)
        if not near.any():
            return None
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        if table:
            signs = np.stack([np.frombuffer(s, ">u4") for s in group["signs"]])
            first = np.ones(len(a), bool)
            for s in range(0, len(a), 200_000):
                e = s + 200_000
                first[s:e] = ~(signs[a[s:e], :table] == signs[b[s:e], :table]).any(axis=1)
            a, b = a[first], b[first]
            if not len(a):
                return None
        cid, n = group["cid"].to_numpy(), group["n"].to_numpy()
        links = np.bincount(a, n[b], len(group)) + np.bincount(b, n[a], len(group))
        root = np.arange(len(group))
        order = np.argsort(cid, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(group))
        lab = rank.copy()
        while True:
            before = lab.copy()
            low = np.minimum(lab[a], lab[b])
            np.minimum.at(lab, a, low)
            np.minimum.at(lab, b, low)
            lab = np.minimum(lab, lab[order[lab]])
            if (lab == before).all():
                break
        root = order[lab]
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"cid": cid[hit], "links": links[hit].astype(np.int64), "root": cid[root[hit]]})

    return work


def near_vectors(
    table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept)."""
    kind = table.select(col(vector)).schema[0].dataType
    wide = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    numbers = col(vector) if wide else col(vector).cast("array<double>")
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    fine = (
        col(label).isNotNull() & numbers.isNotNull() & F.forall(numbers, good)
        & F.exists(numbers, lambda v: v != 0)
    )
    plain = F.transform(numbers, lambda v: F.when(v == 0, F.lit(0)).otherwise(v))  # -0.0 is 0.0
    rows = materialise(
        table.select(
            col(id).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), plain).alias("vector"),
            col(label).cast("string").alias("label"),
        ).select(
            "vec_id", "vector", "label",
            F.when(F.col("vector").isNotNull(), F.xxhash64("vector", "label")).alias("h1"),
            F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(7), "label", "vector")).alias("h2"),
        ),
        "vectors",
    )
    classes = (
        rows.where(F.col("vector").isNotNull()).groupBy("h1", "h2")
        .agg(F.max("vector").alias("vector"), F.max("label").alias("label"), F.count("*").alias("n"),
             F.min("vec_id").alias("vec_id"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialise(classes, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = parameters(largest, threshold, recall)
    signed = materialise(_signatures(classes.select("cid", "label", "vector", "n"), bits, tables, seed), "signs")
    keys = signed.select("cid", "label", "dim", F.posexplode(F.array(*[
        F.substring("signs", 4 * t + 1, 4) for t in range(tables)
    ])).alias("tab", "sign")).select("cid", "tab", F.xxhash64("tab", "label", "dim", "sign").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    members = materialise(keys.join(shared, "key"), "members")
    full = members.join(signed, "cid").select(
        "key", F.col("n_rows").alias("size"), "cid", "tab", "label", "dim", F.col("n").alias("copies"), "vec", "signs"
    )
    full = full.withColumnRenamed("size", "n")
    pairs = block_pairs(full).withColumnRenamed("copies", "n")
    found = materialise(
        map_groups(pairs, _links(threshold), "cid bigint, links bigint, root bigint"), "links"
    )
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("cid", "h1", "h2", "n", "vec_id")
        .join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
        .join(roots.withColumnRenamed("id", "cid"), "cid", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "vec_id",
                F.coalesce("root", "cid").alias("root"))
    )
    names = per_class.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    per_class = materialise(per_class.drop("vec_id").join(names, "root").drop("root"), "vector-classes")
    return rows.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
