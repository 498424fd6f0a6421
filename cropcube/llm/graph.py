"""Connected components by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropcube.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b of one orderable type); root is the least node.

    Each round lets every node hand its larger neighbours, then its smaller ones, to the least node it knows
    (large-star and small-star contraction). The minimum of a node is a partial aggregate and the neighbours meet it by a
    join, so a node with a third of all edges does not land in one task as a group. A round's result is a table in the
    shared folder. Nulls and loops are dropped; no edges give no rows.
    """
    e = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct()
    )
    seen = _state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("v").alias("u"), F.col("p").alias("w")).union(e.select(F.col("p"), F.col("v")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("p")).where("v <> p").distinct()
        low = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(low, "v").select(F.col("p").alias("v"), F.col("m").alias("p")).where("v <> p").union(low.select("v", F.col("m").alias("p"))).distinct()
        after = scratch.table(small)
        state = _state(after)
        scratch.drop(e)
        e = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("p").alias("root")).union(e.select(F.col("p"), F.col("p")).distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free fingerprint of them: equal after a round that changed nothing."""
    row = e.select(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("v", "p")), F.lit(0))).first()
    return row[0], row[1]
