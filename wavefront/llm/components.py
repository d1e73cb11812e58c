"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum, which is partly made before the shuffle, and a
join of the links with these minima. While links are few (they have been
counted), all steps run in one partition, without a shuffle: however many
partitions the session has, each would write files of its own in every round.
Beyond that the minima are a table of their own, so that both sides of the join
are shuffled for it and adaptive execution can split the links of one node, and
the files of a round go before the next. The number of rounds grows with the
logarithm of the longest chain; no link, component or label is ever collected by
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, durable, release


def _side(least: DataFrame, few: bool) -> DataFrame:
    """At most two rows for each link."""
    return F.broadcast(least) if few else durable(least)


def _union(one: DataFrame, two: DataFrame, few: bool) -> DataFrame:
    both = one.unionByName(two)
    return both.coalesce(1) if few else both


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = _union(edges, edges.select(F.col("b").alias("a"), F.col("a").alias("b")), few)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(_side(least, few), "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """``edges`` has a > b in every row."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    side = _side(least, few)
    moved = edges.join(side, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _union(moved, least.withColumnRenamed("m", "b"), few).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component: the least node reachable.

    ``edges``: columns a and b of one orderable type. Nulls and loops are
    ignored; repeated and reversed links are as good as one. No links: no rows.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        few = 2 * state["n"] <= SMALL_ROWS
        if few:
            edges = edges.coalesce(1)
        if tuple(state) == seen or not state["n"]:
            return _union(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct(), few)
        seen = tuple(state)
        edges = _large_star(edges, few)
        if not few:
            edges = durable(edges)
        edges = durable(_small_star(edges, few))
        if not few:
            release(edges.sparkSession)
