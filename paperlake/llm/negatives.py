"""Hard negatives: for each anchor and positive, the highest scored rows of other labels within a window of scores.

A row takes part if its label and vector are not null and all components are finite. Components become
floor(SCALE * x); a row's score is its integer inner product with the anchor. Higher scores come first, ties by smaller id. An anchor's
positives are its first ``n_positives`` other rows of its label. A positive of score p asks for the first ``n_negatives``
rows of other labels with a score from LOW / 100 * p to p.

The windows of an anchor overlap; their upper limits, the positives' scores, split the scores into disjoint slots: slot t holds
the scores above limit t + 1 and up to limit t. Every task scores its rows against a block of anchors and keeps the
first ``n_negatives`` rows of each slot only, batch after batch, so a combiner sends at most n_positives * n_negatives rows per anchor.
The combined slots of an anchor are then merged from the lowest to the highest: the merge of slot t and all below it holds the
first rows up to limit t, which answers that positive once its lower limit has been applied. A window is the upper end
of all scores up to its limit, so keeping the first rows of each slot loses none of it.

Anchors are handed out in blocks of at most BLOCK_BYTES; each block is one pass over all rows, which are not shuffled. The
driver holds one block at a time.

Defined cases: an id names one row; of rows with the same id the smallest (label, components) counts. Rows without an id take no part. Vectors of
different lengths are compared as if the shorter one ended in zeros. Components so large that an inner product could leave
the exact range of doubles are computed as whole numbers, and scores are held to 64 bits. An anchor without positives, and a
positive of negative score, give no rows. An empty table gives no rows. Foreign columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import col
from paperlake.session import materialise

POSITIVES, NEGATIVES, LOW, SCALE = 5, 5, 80, 256
#: Most bytes of anchors, as doubles with their limits, that a pass hands to the tasks.
BLOCK_BYTES = 16 << 20
#: Rows and anchors of one product of matrices.
ROWS, ANCHORS = 4096, 512
FOUND = "anchor_id bigint, slot int, id bigint, score bigint"


def participants(table: DataFrame, id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    x = F.transform(col(vector), lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    finite = F.forall(col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = table.where(finite & col(id).isNotNull() & label.isNotNull()).select(
        col(id).cast("bigint").alias("id"), F.struct(label.cast("string").alias("label"), x.alias("vector")).alias("row")
    )
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a column as rows of ``width`` numbers: shorter ones end in zeros, longer ones are cut, as the
    other side has only zeros there."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; held to 64 bits."""
    top = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if top < 2.0 ** 53:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in rows]
    bound = (1 << 63) - 1
    return np.array([[max(-bound, min(bound, sum(int(a) * b for a, b in zip(x, y, strict=True)))) for y in whole] for x in anchors],
                    np.int64).reshape(len(anchors), len(rows))


def _first(anchor: np.ndarray, slot: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` rows of each anchor and slot, by falling score and then id."""
    order = np.lexsort((ids, -score, slot, anchor))
    anchor, slot = anchor[order], slot[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    keep = rank < k
    return anchor[keep], slot[keep], ids[order][keep], score[order][keep]


def combine(rows: DataFrame, block: dict[str, np.ndarray], k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, id, score): of each partition, the first ``k`` rows per anchor and slot.

    ``block`` holds the anchors' ids, labels, vectors and ``limits``: (lowest score wanted, upper limits by falling score), padded with
    the last limit. ``same`` asks for rows of the anchor's label, else of other labels.
    """
    held = rows.sparkSession.sparkContext.broadcast(block)
    label_ids = {x: i for i, x in enumerate(sorted(set(block["label"])))}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        limits, least = own["limits"], own["least"]
        labels = np.array([label_ids[x] for x in own["label"]])
        state = (np.zeros(0, np.int64),) * 4
        # the k-th score of the open slot with the most rows: what lies below can't enter it
        floor = least.copy()
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                ids = batch.column("id").to_numpy()
                other = np.array([label_ids.get(x, -1) for x in batch.column("label").to_pylist()])
                x = _matrix(batch.column("vector"), own["vector"].shape[1])
                parts = [state]
                for a in range(0, len(labels), ANCHORS):
                    mine = slice(a, a + ANCHORS)
                    score = _scores(own["vector"][mine], x)
                    fit = (labels[mine, None] == other[None, :]) == same
                    fit &= (score >= floor[mine, None]) & (score <= limits[mine, :1])
                    if same:
                        fit &= own["id"][mine, None] != ids[None, :]
                    at, row = np.nonzero(fit)
                    score = score[at, row]
                    slot = (score[:, None] <= limits[mine][at]).sum(axis=1) - 1
                    parts.append((at + a, slot, ids[row], score))
                state = _first(*(np.concatenate(p) for p in zip(*parts, strict=True)), k)
                if limits.shape[1] == 1:
                    full = np.bincount(state[0], minlength=len(labels)) >= k
                    worst = np.full(len(labels), np.iinfo(np.int64).max)
                    np.minimum.at(worst, state[0], state[3])
                    floor = np.where(full, worst, floor)
        anchor, slot, ids, score = state
        yield pa.RecordBatch.from_pydict({
            "anchor_id": pa.array(own["id"][anchor]), "slot": pa.array(slot, pa.int32()), "id": pa.array(ids), "score": pa.array(score),
        })

    return rows.select("id", "label", "vector").mapInArrow(work, FOUND)


def blocks(anchors: DataFrame, bytes_: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """Anchors in blocks of at most so many bytes, by a hash of the id."""
    size, most = anchors.agg(F.sum(F.size("vector") * 8 + 128), F.max(F.size("vector"))).first()
    many = max(1, -(-2 * (size or 0) // bytes_))
    for k in range(many):
        yield anchors.where(F.pmod(F.xxhash64("id"), F.lit(many)) == k)


def _collected(block: DataFrame, limits: bool) -> dict[str, np.ndarray] | None:
    rows = block.toArrow()
    if not rows.num_rows:
        return None
    vectors = rows.column("vector").combine_chunks()
    width = max(1, int(np.diff(vectors.offsets.to_numpy()).max()))
    top = np.iinfo(np.int64)
    out = {"id": rows.column("id").to_numpy(), "label": rows.column("label").to_pylist(), "vector": _matrix(vectors, width)}
    if limits:
        own = rows.column("limits").to_pylist()
        most = max(map(len, own))
        padded = np.full((len(own), most), top.min, np.int64)
        for r, x in zip(padded, own, strict=True):
            r[:len(x)] = x
        return out | {"limits": padded, "least": rows.column("least").to_numpy()}
    return out | {"limits": np.full((len(rows), 1), top.max), "least": np.full(len(rows), top.min)}


def _passes(rows: DataFrame, anchors: DataFrame, k: int, same: bool, label: str) -> DataFrame:
    """``combine`` for all blocks of anchors, written block by block."""
    found = None
    for block in blocks(anchors):
        held = _collected(block, not same)
        if held is not None:
            part = materialise(combine(rows, held, k, same), label)
            found = part if found is None else found.union(part)
    return rows.sparkSession.createDataFrame([], FOUND) if found is None else found


def hard_negatives(
    table: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor``, an
    expression over ``id``, holds."""
    rows = materialise(participants(table, id, vector, col("label") if label is None else label), "vectors")
    anchors = materialise(rows.where(anchor), "anchors")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    positives = _passes(rows, anchors, n_positives, True, "near-positives")
    positives = positives.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives)
    per_anchor = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    per_anchor = materialise(per_anchor, "positives")
    # slots end at the distinct scores of the positives of score 0 and more; the others' windows are empty
    asked = F.array_distinct(F.transform(F.filter("positives", lambda p: p["score"] >= 0), lambda p: p["score"]))
    limited = per_anchor.select(F.col("anchor_id").alias("id"), asked.alias("limits")).where(F.size("limits") > 0)
    limited = limited.withColumn("least", F.ceil(F.element_at("limits", -1) * F.lit(low).cast("decimal(20,0)") / 100).cast("bigint"))
    kept = _passes(rows, anchors.join(limited, "id"), n_negatives, False, "slots")

    inner = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    top = kept.withColumn("place", F.row_number().over(inner)).where(F.col("place") <= n_negatives)
    one = F.struct((-F.col("score")).alias("down"), F.col("id"))
    slots = top.groupBy("anchor_id", "slot").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    slots = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "rows"))).alias("slots"))
    # from the lowest slot upwards: ``upto`` holds for each slot the first rows of it and all below
    none = F.array().cast("array<struct<slot:int,rows:array<struct<down:bigint,id:bigint>>>>")

    def add(merged: Column, s: Column) -> Column:
        below = F.coalesce(F.get(merged, F.lit(0))["rows"], F.array().cast("array<struct<down:bigint,id:bigint>>"))
        both = F.slice(F.sort_array(F.concat(s["rows"], below)), 1, n_negatives)
        return F.concat(F.array(F.struct(s["slot"].alias("slot"), both.alias("rows"))), merged)

    merged = slots.withColumn("upto", F.aggregate(F.reverse("slots"), none, add)).select("anchor_id", "upto")
    asked = per_anchor.join(merged, "anchor_id").withColumn(
        "limits", F.array_distinct(F.transform(F.filter("positives", lambda p: p["score"] >= 0), lambda p: p["score"]))
    )
    each = asked.select("anchor_id", "upto", "limits", F.explode(F.filter("positives", lambda p: p["score"] >= 0)).alias("p"))
    # the slot of a positive, or the highest one below it that has rows
    own = F.array_position("limits", F.col("p.score")) - 1
    answer = F.get(F.filter("upto", lambda u: u["slot"] >= own), F.lit(0))["rows"]
    wide = F.lit(100).cast("decimal(20,0)")
    answer = F.filter(answer, lambda r: -r["down"] * wide >= F.col("p.score") * F.lit(low).cast("decimal(20,0)"))
    out = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"),
                      F.posexplode(answer).alias("rank", "n"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
                      "positive_score", (-F.col("n.down")).alias("negative_score"))
