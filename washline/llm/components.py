"""Connected components of an edge table, in rounds of narrow joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import discard, stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``); the root is the smallest node.

    A round hands each node the smallest root among its neighbours and then follows roots to
    their own root, so the reach of a root doubles: the number of rounds grows with the
    logarithm of the longest path. Minima are combined before each shuffle; a node with very
    many neighbours is the skewed side of a plain join, which adaptive execution splits.
    """
    both = stage(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges"
    )
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("root")
    ), "roots")
    before = None
    for _ in range(max_rounds):
        near = (
            both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("r").alias("near"))
        )
        met = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        # The root of my root is also mine; offers to old roots pull whole trees along.
        offers = met.select("node", "root").union(met.select(F.col("old").alias("node"), "root"))
        hooked = stage(offers.groupBy("node").agg(F.min("root").alias("root")), "roots")
        jumped = hooked.alias("x").join(hooked.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("x.root") == F.col("n2"))
        old, roots = roots, stage(jumped.select("node", F.col("r2").alias("root")), "roots")
        discard(old)
        discard(hooked)
        # Two 64-bit sums over all (node, root) tell whether any root changed, without a join.
        mark = F.xxhash64("node", "root")
        after = tuple(roots.agg(F.bit_xor(mark), F.sum(F.xxhash64(mark).cast("decimal(38,0)"))).first())
        if after == before:
            discard(both)
            return roots
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
