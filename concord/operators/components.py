"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import cut, drop_cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction: link each node's neighbours to the least node it sees.

    The least node comes from a partial aggregate, so a node with very many neighbours costs one row
    a task; the join that follows may be split by adaptive execution.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    links = joined.where(F.col("v") != F.col("m")) if small else joined.where(F.col("v") > F.col("u"))
    out = links.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its least node.

    Self links are ignored; nulls too.  Nothing is collected: each round's edges are a shared table.
    Raises RuntimeError if labels still change after ``rounds``.
    """
    a, b = F.col(left), F.col(right)
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = cut(_star(_star(now, False), True), "edges")
        drop_cut(now)
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
