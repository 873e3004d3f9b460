"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import shared
from annalist.llm.shared import checkpointed, join_values, released

MAX_ROUNDS = 60
#: Rounds between checkpoints of small graphs. A round is two shuffles.
STRIDE = 2
#: A node may be hot if it has more links than this.
LINKS = 1 << 16


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (a, b), repeated ones dropped, with m, the least b of a. The windows stream over a node's sorted links."""
    by = Window.partitionBy("a").orderBy("b")
    seen = pairs.withColumns({"m": F.first("b").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_prev": F.lag("b").over(by)})
    return seen.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("b"))).drop("_prev")


def _round(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a > b, each turned into one edge at most, so a round adds none."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    # large star: neighbours above a node are linked to the least of the node and its neighbours
    large = _stars(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    # small star: neighbours below a node, and the node itself, are linked to the least of them
    return _stars(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _hot_round(edges: DataFrame) -> DataFrame:
    """The same round where some nodes have very many links: minima and counts are aggregated before they are shuffled,
    and join_values gives them to the links, so no task gets all links of a node."""
    lower = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    upper = checkpointed(edges.groupBy("b").agg(F.count(F.lit(1)).alias("count")).join(lower, "b", "left"))
    # the least neighbour of b is below it if there is one below, which is then what its upper neighbours get
    large = checkpointed(join_values(edges, upper, ["b"], "count").select("a", F.coalesce("m", "b").alias("b")))
    least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("count")))
    small = join_values(large, least, ["a"], "count").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    out = checkpointed(small.distinct())
    released(upper, large, least)
    return out


def _has_hot_nodes(edges: DataFrame, n: int) -> bool:
    if n <= LINKS:
        return False
    most = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().agg(F.max("count")).first()[0]
    return most > max(LINKS, n // shared.HOT)


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of links (a, b); ids are non-null longs.

    The number of rounds grows with the logarithm of the longest path.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 24)))).first()
        if now == state or not now.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state, before = now, edges
        if _has_hot_nodes(edges, now.n):
            edges = _hot_round(edges)
        else:
            for _ in range(STRIDE if now.n <= LINKS else 1):
                edges = _round(edges)
            edges = checkpointed(edges)
        released(before)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
