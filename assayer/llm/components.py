"""Connected components of an undirected graph in DataFrame joins, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.places import kept


def flattened(hooks: DataFrame) -> DataFrame:
    """(node, root): every chain of (node, root) followed to its end; roots are smaller, so there is no cycle."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = kept(hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        hooks = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is named by its smallest node.

    Each round hooks every root to its smallest smaller neighbour, follows the chains, and contracts the
    edges onto the roots, until none is left between different roots; what is left shrinks by the round.
    Null ends are ignored; an empty graph gives no rows.
    """
    ordered = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    left = kept(ordered.filter("lo is not null and hi is not null and lo < hi").distinct(), "edges")
    parents = None
    while not left.isEmpty():
        hooks = left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        hooks = flattened(hooks)
        if parents is None:
            parents = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            parents = kept(moved.union(hooks.join(parents, "node", "left_anti")), "parents")
        lo = hooks.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        hi = hooks.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        mapped = left.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))
        left = kept(mapped.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    if parents is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    roots = parents.select(F.col("root").alias("node")).distinct().join(parents, "node", "left_anti")
    return parents.select("node", F.col("root").alias("component")).union(roots.select("node", F.col("node").alias("component")))
