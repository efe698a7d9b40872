"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written

#: A node with more than one in so many of all edge ends is joined by broadcast: there are at most so many such nodes.
HOT = 1000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Each step keeps one row per edge and finds the smallest neighbour by a pre-aggregated group. A node with very many
    neighbours is never gathered in one task: those with more than a thousandth of all edge ends (HOT of them at most)
    meet their edges by broadcast, wherever these are. Steps repeat until the edges no longer change, O(log n) times as
    a rule; each result is written to the shared folder, which cuts lineage. Null ends are left out.
    """
    pairs = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct(), "pairs")
    now = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = written(_large(now, state[0]), "edges")
        now = written(_small(now, state[0]), "edges")
        before, state = state, _state(now)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = pairs.filter("a = b").select(F.col("a").alias("node")).join(found.select("node").union(roots.select("node")).distinct(), "node", "left_anti")
    return found.union(roots.distinct()).union(alone.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(rows: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n), n being the number of edge ends at u."""
    hot = least.filter(F.col("n") * HOT > ends).select("u", F.col("m").alias("_m"))
    spread = rows.join(F.broadcast(hot), "u", "left")  # fewer than HOT rows, as all n add up to ends
    cold = spread.filter("_m IS NULL").select("u", "v").join(least.filter(F.col("n") * HOT <= ends).select("u", "m"), "u")
    return cold.union(spread.filter("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")))


def _large(edges: DataFrame, count: int) -> DataFrame:
    """Joins the larger neighbours of each node to the smallest of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _joined(both.filter("v > u"), least, 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, count: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them. A large-star step never adds edges, so count
    bounds those here too."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _joined(edges, least, count).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
