"""Level-synchronous breadth-first search.

A level is one join of the adjacency with the new vertices, or, when many are
new, of what is not yet visited with its neighbours among them; then a grouped
minimum names the parent. The direction rule is a pure function of counts.
The parent of a vertex is its least neighbour one level up, so results don't
depend on partitioning or direction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import durable
from ..schema import LEVELS, TREE
from . import graph

# Fixed values of the direction rule.
ALPHA = 2000
BETA = 8
# Fixed value: neighbours of a large row.
LARGE_ROW = 2000
#: A side of a join is broadcast up to so many rows; its rows have been counted then.
BROADCAST_ROWS = 100_000
#: Levels after which the levels so far become one table. Every level is written
#: to the checkpoint folder: plans stay as small as at the start, and a lost
#: executor costs no level.
MERGE_EVERY = 8


@dataclass(frozen=True)
class Direction:
    """The state of the rule: which way the next level runs, and whether the search may still grow."""

    forward: bool = True
    growing: bool = True
    last: int = 0
    visited: int = 1

    def after(self, found: int, vertices: int) -> Direction:
        """The state after a level that found so many of ``vertices``."""
        now = replace(self, last=found, visited=self.visited + found)
        if self.growing and found > self.last:
            return replace(now, forward=False) if self.forward and found > vertices / ALPHA else now
        if not self.forward and vertices - now.visited < int(vertices / BETA):
            return replace(now, forward=True, growing=False)
        return now


def side(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, one row for each key, as a side of a join with a table of edges: broadcast if it has
    few rows; else its partitions are hashed, so that no level or check has to sort the edges."""
    if rows is None:
        return df
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("shuffle_hash")


@dataclass
class Layout:
    """An adjacency kept for many levels: small rows dealt out by source, so that a level
    needn't move them, and the edges of large rows dealt out one by one.

    ``hubs``: the sources of large rows, ``n_hubs`` of them.
    """

    small: DataFrame
    large: DataFrame | None
    hubs: DataFrame | None
    n_hubs: int

    def join(self, other: DataFrame, rows: int | None, how: str = "inner") -> DataFrame:
        """The edges joined with ``other`` (src and maybe more columns), which has so many rows."""
        out = self.small.join(side(other, rows), "src", how)
        if self.large is None:
            return out
        few = other.join(side(self.hubs, self.n_hubs), "src", "left_semi")
        known = self.n_hubs if how == "left_anti" or rows is None else min(rows, self.n_hubs)
        return out.unionByName(self.large.join(side(few, known), "src", how))

    @property
    def edges(self) -> DataFrame:
        return self.small if self.large is None else self.small.unionByName(self.large)

    def unpersist(self) -> None:
        for kept in (self.small, self.large, self.hubs):
            if kept is not None:
                kept.unpersist()


def _hubs(adj: DataFrame, large: int) -> DataFrame:
    """(src) of the rows of ``large`` neighbours and more.

    Sources are counted in buckets first, which tasks can do before the shuffle; only
    a bucket of ``large`` edges and more can hold such a row, and few buckets have so many.
    """
    buckets = 1 << (adj.count() * 4 // large).bit_length()
    coded = adj.select("src", F.xxhash64("src").bitwiseAND(F.lit(buckets - 1)).alias("bucket"))
    full = coded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= large).select("bucket").persist(StorageLevel.MEMORY_AND_DISK)
    some = coded.join(side(full, full.count()), "bucket", "left_semi")
    hubs = some.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= large).select("src").persist(StorageLevel.MEMORY_AND_DISK)
    hubs.count()
    full.unpersist()
    return hubs


def layout(adj: DataFrame, large: int = LARGE_ROW, source: DataFrame | None = None) -> Layout:
    """``adj``, kept, with the rows of ``large`` neighbours and more apart.

    ``source``: a table of fewer rows that ``adj`` is made of row by row (the edges
    before symmetry), which is kept in place of ``adj`` meanwhile.
    """
    kept = (adj if source is None else source).persist(StorageLevel.MEMORY_AND_DISK)
    hubs = _hubs(adj, large)
    n = hubs.count()
    if not n:
        hubs.unpersist()
        small = adj.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
        small.count()
        kept.unpersist()
        return Layout(small, None, None, 0)
    few = side(hubs, n)
    small = adj.join(few, "src", "left_anti").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    big = adj.join(few, "src", "left_semi").repartition("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    small.count(), big.count()
    kept.unpersist()
    return Layout(small, big, hubs, n)


class Kept:
    """Raw edges kept for a search, each as one row wherever it is; both directions are made while it is read.

    Repeats stay, as they change no least parent. A frontier of few rows is broadcast to the
    edges. Only when one has more are the edges dealt out by source (:func:`layout`), once.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.once = graph.without_loops(edges).select("v0", "v1").persist(StorageLevel.MEMORY_AND_DISK)
        self.dealt: Layout | None = None

    @property
    def edges(self) -> DataFrame:
        return graph.symmetrize(self.once)

    def join(self, other: DataFrame, rows: int | None, how: str = "inner") -> DataFrame:
        if rows is not None and rows <= BROADCAST_ROWS:
            return self.edges.join(side(other, rows), "src", how)
        if self.dealt is None:
            self.dealt = layout(graph.adjacency(self.once))
        return self.dealt.join(other, rows, how)

    def unpersist(self) -> None:
        self.once.unpersist()
        if self.dealt is not None:
            self.dealt.unpersist()


def _joined(adj: DataFrame | Layout | Kept, other: DataFrame, rows: int | None, how: str = "inner") -> DataFrame:
    return adj.join(other, rows, how) if isinstance(adj, Layout | Kept) else adj.join(side(other, rows), "src", how)


def expand(adj: DataFrame | Layout | Kept, frontier: DataFrame, rows: int | None = None) -> DataFrame:
    """(parent, child) for every edge out of the frontier."""
    return _joined(adj, frontier.select(F.col("vertex").alias("src")), rows).select(F.col("src").alias("parent"), F.col("dst").alias("child"))


def top_down_step(adj: DataFrame | Layout | Kept, frontier: DataFrame, visited: DataFrame, rows: int | None = None, seen: int | None = None) -> DataFrame:
    """(vertex, parent) of what the frontier reaches and was not visited."""
    found = expand(adj, frontier, rows).groupBy(F.col("child").alias("vertex")).agg(F.min("parent").alias("parent"))
    return found.join(side(visited.select("vertex"), seen), "vertex", "left_anti")


def unvisited(vertices: DataFrame, visited: DataFrame) -> DataFrame:
    return vertices.join(visited.select("vertex"), "vertex", "left_anti")


def bottom_up_step(adj: DataFrame | Layout | Kept, frontier: DataFrame, visited: DataFrame, rows: int | None = None, seen: int | None = None) -> DataFrame:
    """The same, seen from the vertices that were not visited: each looks for the least
    neighbour in the frontier. Edges of visited vertices leave before the second join."""
    left = _joined(adj, visited.select(F.col("vertex").alias("src")), seen, "left_anti")
    near = left.join(side(frontier.select(F.col("vertex").alias("dst")), rows), "dst")
    return near.groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("parent"))


def frontier_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select("vertex").join(old.select("vertex"), "vertex", "left_anti")


def frontier_intersection(frontier: DataFrame, rows: DataFrame) -> DataFrame:
    return frontier.select("vertex").join(rows.select("vertex"), "vertex", "left_semi")


@dataclass
class Search:
    """``tree``: (vertex, parent, depth); ``levels``: what happened, level by level."""

    tree: DataFrame
    levels: list[dict]

    def levels_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(level[f.name] for f in LEVELS) for level in self.levels], LEVELS)


def bfs(adj: DataFrame | Layout | Kept, root: int, direction: str = "hybrid", vertices: int | None = None, count_relaxed: bool = False) -> Search:
    """The search from one root; ``direction`` is hybrid, top_down or bottom_up.

    ``adj`` is symmetric and read once for each level, so callers keep it
    (:func:`layout`, ``persist``, or a table bucketed by source). ``vertices``: the number of
    vertices with an edge, if known; the hybrid rule counts them else, and other directions leave
    ``unvisited`` open. A root without edges reaches itself.
    ``count_relaxed``: the edges out of each level's frontier, counted in one pass afterwards.
    """
    edges = adj.edges if isinstance(adj, Layout | Kept) else adj
    spark = edges.sparkSession
    if vertices is None and direction == "hybrid":
        vertices = edges.select("src").distinct().count()
    found = spark.createDataFrame([(root, root, 0)], TREE)
    tree, frontier, levels = found, found, []
    state, level, visited, rows = Direction(forward=direction != "bottom_up"), 0, 1, 1
    while rows:
        level += 1
        step = top_down_step if state.forward else bottom_up_step
        new = durable(step(adj, frontier, tree, rows, visited).select("vertex", "parent", F.lit(level).alias("depth")))
        n = new.count()
        visited += n
        levels.append({"level": level, "direction": "top_down" if state.forward else "bottom_up", "nq": n, "visited": visited, "unvisited": None if vertices is None else vertices - visited, "relaxed": None})
        if n:
            tree = tree.unionByName(new)
        frontier, rows = new, n
        if level % MERGE_EVERY == 0 and n:
            tree = durable(tree)
        if direction == "hybrid":
            state = state.after(n, vertices)
    if count_relaxed:
        out = dict(_joined(adj, tree.select(F.col("vertex").alias("src"), "depth"), visited).distinct().groupBy("depth").count().collect())  # one for each level
        for row in levels:
            row["relaxed"] = out.get(row["level"] - 1, 0)
    return Search(tree, levels)


def bfs_many(adj: DataFrame | Layout | Kept, roots: list[int]) -> DataFrame:
    """(root, vertex, parent, depth) for several roots at once: all searches share each level's join."""
    spark = (adj.edges if isinstance(adj, Layout | Kept) else adj).sparkSession
    tree = frontier = spark.createDataFrame([(r, r, r, 0) for r in sorted(set(roots))], "root long, vertex long, parent long, depth int")
    level, rows = 0, len(set(roots))
    while rows:
        level += 1
        reach = _joined(adj, frontier.select("root", F.col("vertex").alias("src")), rows).groupBy("root", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))
        new = reach.join(tree.select("root", "vertex"), ["root", "vertex"], "left_anti")
        frontier = durable(new.select("root", "vertex", "parent", F.lit(level).alias("depth")))
        rows = frontier.count()
        if rows:
            tree = tree.unionByName(frontier)
        if level % MERGE_EVERY == 0 and rows:
            tree = durable(tree)
    return tree


def reachable(adj: DataFrame | Layout | Kept, root: int) -> DataFrame:
    return bfs(adj, root).tree.select("vertex")


def find_roots(draw: Callable[[int], int], with_edges: Callable[[list[int]], set[int]], limit: int, wanted: int, batch: int = 64) -> list[int]:
    """Candidates of a stream: repeats are passed over, the first with an edge are taken.

    ``with_edges`` says which of some candidates have an edge; it is asked for
    ``batch`` at once. ``limit``: how many draws there are. When they are used
    up, the last candidate is taken as it is.
    """
    roots: list[int] = []
    known: dict[int, bool] = {}
    counter = 0
    for _ in range(wanted):
        while True:
            candidate = draw(counter)
            if candidate not in known:
                ahead = [draw(counter + i) for i in range(batch)]
                good = with_edges(ahead)
                known |= {c: c in good for c in ahead}
            counter += 1
            if counter > limit or (candidate not in roots and known[candidate]):
                break
        roots.append(candidate)
    return roots
