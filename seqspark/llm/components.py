"""Connected components of a link table, without collecting links or groups.

Alternating star contraction: every node's larger neighbours move to its smallest one, then
its smaller neighbours do. Minima are map-side aggregates and links a join on the node, so
a hub with any number of links is an ordinary skewed join key, which adaptive execution
splits. Each round is written to the shared folder. The first half of a round may repeat
links; they are made distinct once, at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: root is the smallest node reachable.

    Loops and repeated links do no harm; an empty table gives an empty one; null ends are
    ignored. Nodes without links do not appear, except those with a loop only.
    """
    loops = edges.dropna().filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    pairs = edges.dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "links")
    state = _state(pairs)
    while state[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
        large = stored(large.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b"), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # All links are kept and each node has one: these are stars, and another round changes nothing.
        if _state(large) == state and down.count() == state[0]:
            break
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.union(down.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _state(pairs)
        if now == state:
            break
        state = now
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    linked = found.union(roots)
    return linked.union(loops.join(linked, "node", "left_anti"))
