"""Connected components of an edge table, as joins and aggregates.

Every node points to its smallest neighbour, if that is smaller; the pointers form trees, which are
flattened by pointer jumping. Then the edges are contracted to the roots, and the next round starts.
Each round at least halves the number of nodes with edges, so the rounds grow with the logarithm of
their number. Tables are written to the scratch folder after each step; only row counts reach the
driver.

Defined cases: edges with a null end, and from a node to itself, connect nothing; repeated edges count once. No
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every node with an edge and the smallest node of its component."""
    x, y = F.col(a), F.col(b)
    e = materialise(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(),
        "edges",
    )
    roots = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(
            both.groupBy("a").agg(F.min("b").alias("m")).select(
                F.col("a").alias("id"), F.least("a", "m").alias("root")
            ),
            "parents",
        )
        while True:
            above = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = materialise(
                up.join(above, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
                "jumps",
            )
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("id", "root")
            if not moved:
                break
        if roots is None:
            roots = up
        else:
            higher = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            roots = materialise(
                roots.join(higher, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots"
            )
        left = up.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = e.join(left, "a").join(right, "b").where("ra != rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")
        )
        e = materialise(rest.distinct(), "edges")
        if e.isEmpty():
            return roots
