"""Connected components of an edge table by hooking and shortcutting (FastSV), as joins and minima.

Every step is an aggregation with map-side combining or a join that deals hot keys over parts, so neither a node
with very many edges nor the root of a very large component is met in one task. Rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costloom.llm.common import hot_keys, spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, component (the least node that can be reached) of every node in an edge."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    crowded = written(hot_keys(both, ["b"]))
    f = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("p")))
    nodes = f.count()
    while True:
        up = f.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        g = written(spread_join(f, up, ["p"], "node", hot_keys(f, ["p"], nodes)).select("node", "p", "pp"))
        near = spread_join(both, g.select(F.col("node").alias("b"), "pp"), ["b"], "a", F.broadcast(crowded))
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("pp").alias("m"))
        h = g.join(least, "node", "left").withColumn("m", F.least("pp", F.coalesce("m", "pp")))
        hooks = h.groupBy(F.col("p").alias("node")).agg(F.min("m").alias("h"))
        new = written(h.join(hooks, "node", "left").select("node", F.least("p", "pp", "m", F.coalesce("h", "p")).alias("q"), "p"))
        done = new.filter("q != p").isEmpty()
        f = new.select("node", F.col("q").alias("p"))
        if done:
            return f.select("node", F.col("p").alias("component"))
