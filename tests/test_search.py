"""Search and validation on small graphs made by hand, and random ones."""

from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wavefront.operators import exchange, graph, traverse, validate
from wavefront.schema import EDGES, TREE

PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
LOOPS = [(0, 0), (0, 1), (1, 0), (0, 1)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, EDGES)


def by_hand(pairs, root):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    depth, queue = {root: 0}, deque([root])
    while queue:
        v = queue.popleft()
        for u in near.get(v, ()):
            if u not in depth:
                depth[u] = depth[v] + 1
                queue.append(u)
    return {v: (v if v == root else min(u for u in near[v] if depth.get(u) == d - 1), d) for v, d in depth.items()}


def tree_of(spark, pairs, root, direction="hybrid"):
    adj = graph.adjacency(frame(spark, pairs)).persist()
    return {r["vertex"]: (r["parent"], r["depth"]) for r in traverse.bfs(adj, root, direction).tree.collect()}


@pytest.mark.parametrize("direction", ["hybrid", "top_down", "bottom_up"])
@pytest.mark.parametrize("pairs", [PATH, [(0, i) for i in range(1, 10)], [(0, 1), (2, 3)], LOOPS, [(5, 5), (0, 1)], [(0, 1), (0, 2), (1, 3), (2, 3)]])
def test_hand_made(spark, pairs, direction):
    assert tree_of(spark, pairs, 0, direction) == by_hand(pairs, 0)


def test_root_without_edges(spark):
    assert tree_of(spark, [(5, 5), (0, 1)], 5) == {5: (5, 0)}


def test_deeper_than_the_merge_interval(spark):
    pairs = [(i, i + 1) for i in range(traverse.MERGE_EVERY * 2 + 1)]
    assert tree_of(spark, pairs, 0) == by_hand(pairs, 0)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=40))
def test_random_graphs(spark, pairs):
    assert tree_of(spark, pairs, pairs[0][0]) == by_hand(pairs, pairs[0][0])


def test_many_roots(spark):
    adj = graph.adjacency(frame(spark, PATH)).persist()
    got = {(r["root"], r["vertex"]): r["depth"] for r in traverse.bfs_many(adj, [0, 4]).collect()}
    assert got == {(r, v): abs(r - v) for r in (0, 4) for v in range(5)}


def test_direction_rule():
    vertices, state, seen = 899, traverse.Direction(), []
    for found in (2, 138, 706, 50, 0):
        seen.append(state.forward)
        state = state.after(found, vertices)
    assert seen == [True, False, False, False, True]


def test_root_selection():
    stream = [3, 3, 5, 9, 1, 7]
    assert traverse.find_roots(lambda i: stream[i % 6], lambda c: set(c) & {3, 9, 7}, 100, 3) == [3, 9, 7]
    assert traverse.find_roots(lambda i: stream[i % 6], lambda c: set(), 4, 1) == [1]


def test_degrees_and_traversed_edges(spark):
    raw = frame(spark, LOOPS + [(2, 3)])
    assert dict(map(tuple, graph.degrees(raw).collect())) == {0: 3, 1: 3, 2: 1, 3: 1}
    tree = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], TREE)
    assert validate.edge_visit_count(raw, tree).first()["n"] == 4


CORRUPT = {
    "parent_range": {3: (99, 3)},
    "root_parent": {0: (1, 0)},
    "self_parent": {4: (4, 4)},
    "depth_presence": {0: (0, 1)},
    "depth_step": {4: (3, 5)},
    "edge_leaves_tree": {4: None},
    "edge_spans_levels": {4: (3, 6)},
    "tree_edge_exists": {4: (2, 4)},
}


@pytest.mark.parametrize("check", CORRUPT)
def test_corrupted_trees(spark, check):
    raw = frame(spark, PATH)
    rows = by_hand(PATH, 0) | CORRUPT[check]
    tree = spark.createDataFrame([(v, *x) for v, x in rows.items() if x], TREE)
    found = {r["check"]: r["violations"] for r in validate.violations(raw, tree, 0, 5).collect()}
    assert found[check] > 0
    assert not validate.validate(raw, tree, 0, 5)[0]


def test_clean_tree_and_depths(spark):
    raw = frame(spark, PATH + LOOPS)
    tree = spark.createDataFrame([(v, *x) for v, x in by_hand(PATH, 0).items()], TREE)
    assert all(r["violations"] == 0 for r in validate.violations(raw, tree, 0, 5).collect())
    assert dict(map(tuple, validate.depth_from_parents(tree, 0).collect())) == {v: v for v in range(5)}
    assert validate.validate(raw, tree, 9, 5)[2] == ["root_range", "root_parent"]


def test_cycle_of_parents_has_no_depth(spark):
    tree = spark.createDataFrame([(0, 0, 0), (1, 2, 1), (2, 1, 2)], TREE)
    assert [tuple(r) for r in validate.depth_from_parents(tree, 0).collect()] == [(0, 0)]


def test_empty_edges(spark):
    raw = frame(spark, [])
    assert graph.adjacency(raw).count() == 0
    assert graph.scale_estimate(raw).first()["scale"] == 0
    assert graph.num_vertices(raw).first()["n"] == 0
    assert graph.csr_offsets(graph.adjacency(raw)).count() == 0


def test_bitmaps(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 7, 8, 32767, 32768, 100000)], "vertex long")
    back = graph.bitmap_members(graph.bitmap(ids)).orderBy("vertex")
    assert [r["vertex"] for r in back.collect()] == [0, 1, 7, 8, 32767, 32768, 100000]
    assert back.where(F.col("vertex") < 0).isEmpty()

def test_large_rows_apart(spark):
    """A hub with a third of all edges: its edges lie in many tasks, and searches agree with those over a plain table."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, 400 + i % 20) for i in range(100)] + [(420, 400), (901, 902)], "v0 long, v1 long")
    adj = graph.adjacency(edges).persist()
    kept = traverse.layout(adj, large=100)
    assert kept.n_hubs == 1 and kept.large.select("src").distinct().count() == 1 and kept.edges.count() == adj.count()
    assert max(len(p) for p in kept.large.rdd.glom().collect()) < 300
    for direction in ("top_down", "bottom_up", "hybrid"):
        one, two = traverse.bfs(kept, 3, direction), traverse.bfs(adj, 3, direction)
        assert sorted(map(tuple, one.tree.collect())) == sorted(map(tuple, two.tree.collect())) and one.levels == two.levels
    assert sorted(map(tuple, traverse.bfs_many(kept, [3, 901]).collect())) == sorted(map(tuple, traverse.bfs_many(adj, [3, 901]).collect()))
    kept.unpersist()


def test_search_over_kept_edges(spark, monkeypatch):
    """Repeats, loops and both kinds of frontier: the tree and the counts are those of the adjacency; few rows move nothing."""
    pairs = [(i, j) for i in range(0, 60, 2) for j in (i + 1, i * 7 % 60 + 1, i + 2)] * 2 + [(4, 4), (901, 902)]
    adj = graph.adjacency(frame(spark, pairs)).persist()
    want = traverse.bfs(adj, 0, "top_down", count_relaxed=True)
    assert [r["relaxed"] for r in want.levels] == [adj.join(want.tree.where(F.col("depth") == r["level"] - 1), F.col("src") == F.col("vertex")).count() for r in want.levels]
    for few in (traverse.BROADCAST_ROWS, 2):
        monkeypatch.setattr(traverse, "BROADCAST_ROWS", few)
        kept = traverse.Kept(frame(spark, pairs))
        got = traverse.bfs(kept, 0, "top_down", count_relaxed=True)
        assert sorted(map(tuple, got.tree.collect())) == sorted(map(tuple, want.tree.collect()))
        assert [(r["nq"], r["relaxed"]) for r in got.levels] == [(r["nq"], r["relaxed"]) for r in want.levels]
        assert (kept.dealt is None) == (few > 2)
        assert sorted(map(tuple, traverse.bfs_many(kept, [0, 901]).collect())) == sorted(map(tuple, traverse.bfs_many(adj, [0, 901]).collect()))
        kept.unpersist()


def test_redistribution_shares_a_member(spark):
    """All edges belong to one member; no task holds them all."""
    edges = spark.range(4000).select((F.col("id") * 6).alias("v0"), (F.col("id") * 6).alias("v1"))
    spread = exchange.redistribute(edges, 1, 2)
    assert spread.select("owner").distinct().count() == 1 and spread.count() == 4000
    assert max(spread.rdd.glom().map(len).collect()) < 3000
