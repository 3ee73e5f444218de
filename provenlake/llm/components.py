"""Connected components of a table of links, by alternating stars, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.common import discard, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b): neighbours above a node (large), or a node and those below it (small), go to the least of
    all. The least is aggregated before it is joined, so that a hub is no group."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable; only nodes with links. A stashed table."""
    edges = stash(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "edges")
    before = None
    for _ in range(60):
        after = stash(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle in 60 rounds")
    out = stash(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct()), "components")
    discard(edges)
    return out
