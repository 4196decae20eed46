"""Connected components of an undirected edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.staging import cut, drop_staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of a non-trivial component; root is the component's least node.

    edges: two columns of one ordered type (long or string). Null ends, self-loops, repeated and
    reversed edges are allowed and mean nothing. Each round hangs every node's larger neighbours
    on its least neighbour and then its smaller ones, so that stars remain after a number of
    rounds that grows with the logarithm of the longest path. A round keeps one row per node and
    star centre at most; no task sees a whole component.
    """
    x, y = F.col(a), F.col(b)
    cur = cut(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    mark = _mark(cur)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # a round never makes more rows than two for each node, and a star has one for each
        new = cut(_small_star(_large_star(cur)), "edges", rows=2 * mark[0])
        now = _mark(new)
        drop_staged(cur)
        cur = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
