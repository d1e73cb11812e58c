"""Checks of a search tree against the raw edges, and the count of traversed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import durable
from .traverse import side

#: Later groups say nothing where an earlier one failed.
GROUPS = [["parent_range", "root_range", "root_parent"], ["self_parent"], ["depth_presence", "depth_step"], ["edge_leaves_tree", "edge_spans_levels", "tree_edge_exists"]]
CHECKS = [check for group in GROUPS for check in group]


def _count(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)


def tree_checks(tree: DataFrame, root: int, vertices: int) -> DataFrame:
    """What the tree alone tells, in one row. ``vertices``: ids are below it."""
    vertex, parent, depth = F.col("vertex"), F.col("parent"), F.col("depth")
    return tree.agg(
        _count((parent < 0) | (parent >= vertices), "parent_range"),
        F.when(F.lit(0 <= root < vertices), 0).otherwise(1).cast("long").alias("root_range"),
        F.when(F.coalesce(F.sum(F.when((vertex == root) & (parent == root), 1)), F.lit(0)) == 0, 1).otherwise(0).cast("long").alias("root_parent"),
        _count((vertex == parent) & (vertex != root), "self_parent"),
        _count(depth.isNull() | parent.isNull() | (vertex == root) & (depth != 0), "depth_presence"),
    )


def depth_steps(tree: DataFrame, root: int) -> DataFrame:
    """Vertices whose parent is not in the tree or not exactly one level up."""
    up = side(tree.select(F.col("vertex").alias("parent"), F.col("depth").alias("parent_depth")), tree.count())
    joined = tree.where(F.col("vertex") != root).join(up, "parent", "left")
    return joined.where(~F.coalesce(F.col("depth") == F.col("parent_depth") + 1, F.lit(False))).select("vertex")


def with_depths(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Raw edges with the depths of both ends, null where not reached."""
    n = tree.count()
    d0 = side(tree.select(F.col("vertex").alias("v0"), F.col("depth").alias("d0")), n)
    d1 = side(tree.select(F.col("vertex").alias("v1"), F.col("depth").alias("d1")), n)
    return edges.select("v0", "v1").join(d0, "v0", "left").join(d1, "v1", "left")


def edge_checks(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """What edges say, in one row: violations, and the edges with both ends reached."""
    d0, d1 = F.col("d0"), F.col("d1")
    return with_depths(edges, tree).agg(
        _count(d0.isNull() != d1.isNull(), "edge_leaves_tree"),
        _count(d0.isNotNull() & d1.isNotNull() & (F.abs(d0 - d1) > 1), "edge_spans_levels"),
        _count(d0.isNotNull() & d1.isNotNull(), "visited"),
    )


def edge_visit_count(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Raw edges, repeats and loops included, of which both ends are in the tree."""
    n, reached = tree.count(), tree.select("vertex")
    both = edges.join(side(reached.withColumnRenamed("vertex", "v0"), n), "v0", "left_semi").join(side(reached.withColumnRenamed("vertex", "v1"), n), "v1", "left_semi")
    return both.agg(F.count("*").alias("n"))


def missing_tree_edges(edges: DataFrame, tree: DataFrame, root: int) -> DataFrame:
    """Vertices whose edge to the parent is in the input in neither direction."""
    ends = edges.select(F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b"))
    named = tree.where(F.col("vertex") != root).select("vertex", F.least("vertex", "parent").alias("a"), F.greatest("vertex", "parent").alias("b"))
    found = ends.join(side(named.select("a", "b"), tree.count()), ["a", "b"], "left_semi").distinct()  # no more rows than the tree; edges of no name leave before any shuffle where it is small
    return named.join(found, ["a", "b"], "left_anti").select("vertex")


def violations(edges: DataFrame, tree: DataFrame, root: int, vertices: int) -> DataFrame:
    """(check, violations) for all checks, each counted whatever the others find."""
    wide = tree_checks(tree, root, vertices).crossJoin(edge_checks(edges, tree))  # of one row and one row
    wide = wide.crossJoin(depth_steps(tree, root).agg(F.count("*").alias("depth_step"))).crossJoin(missing_tree_edges(edges, tree, root).agg(F.count("*").alias("tree_edge_exists")))
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in CHECKS])
    return wide.select(F.explode(pairs).alias("x")).select("x.*")


def validate(edges: DataFrame, tree: DataFrame, root: int, vertices: int) -> tuple[bool, int, list[str]]:
    """Whether the tree is right, the traversed edges, and the checks that failed.

    Groups of checks run in order and end with the first that fails, as later
    ones take for granted what earlier ones check.
    """
    alone = tree_checks(tree, root, vertices).first().asDict()
    for group in GROUPS[:2]:
        if failed := [c for c in group if alone[c]]:
            return False, 0, failed
    failed = ["depth_presence"] * bool(alone["depth_presence"]) + ["depth_step"] * (not depth_steps(tree, root).isEmpty())
    if failed:
        return False, 0, failed
    seen = edge_checks(edges, tree).first()
    failed = [c for c in GROUPS[3][:2] if seen[c]] + ["tree_edge_exists"] * (not missing_tree_edges(edges, tree, root).isEmpty())
    return not failed, seen["visited"], failed


def first_violations(tree: DataFrame, edges: DataFrame, root: int, cap: int = 10) -> DataFrame:
    """A few offending vertices to show; the counts are in :func:`violations`."""
    return depth_steps(tree, root).unionByName(missing_tree_edges(edges, tree, root)).orderBy("vertex").limit(cap)


def depth_from_parents(tree: DataFrame, root: int) -> DataFrame:
    """(vertex, depth) by following parents, doubling the distance each round.

    Vertices that never come to the root (a cycle, a parent outside the tree)
    have no row.
    """
    up = durable(tree.where((F.col("vertex") != root) & F.col("parent").isNotNull()).select("vertex", F.col("parent").alias("to"), F.lit(1).alias("steps")))
    rounds, limit = 0, max(2, tree.count()).bit_length() + 1
    while rounds < limit and not up.where(F.col("to") != root).isEmpty():
        arrived = up.where(F.col("to") == root)
        ahead = up.select(F.col("vertex").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = up.where(F.col("to") != root).join(ahead, "to").select("vertex", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        up = durable(arrived.unionByName(moved))
        rounds += 1
    own = tree.where(F.col("vertex") == root).select("vertex", F.lit(0).alias("depth"))
    return own.unionByName(up.where(F.col("to") == root).select("vertex", F.col("steps").alias("depth")))
