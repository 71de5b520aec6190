"""Connected components of edges, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import frames


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large star) or not larger (small star) neighbours to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """id, root (the smallest id of its component) of every node of the edges (a, b: long); a kept table."""
    now = frames.kept(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), name)
    seen = None
    while True:
        after = frames.kept(_star(_star(now, True), False), name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        frames.drop_kept(now)
        now = after
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    out = frames.kept(roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()), "roots")
    frames.drop_kept(now)
    return out
