"""Random numbers and generated edges against known values."""

import random

import numpy as np
import pytest
from wavefront.functions import rng
from wavefront.functions.scramble import constants, reverse_bits, scramble
from wavefront.plans.benchmark import TRAVERSED
from wavefront.sources.kronecker import EdgeSpec, edge_arrays, edges, kronecker_edges

SUMS = {4: (37, 54, 3015, 1891), 6: (61, 381, 25383, 31912), 8: (85, 2152, 474732, 545765), 10: (144, 10551, 8513287, 8276180)}
FIRST = {4: [(15, 3), (15, 12), (7, 12)], 8: [(17, 138), (82, 127), (250, 60)], 11: [(1769, 1128), (684, 1046), (2027, 462)], 12: [(2477, 2850), (684, 2881), (2400, 3127)]}


def test_constants():
    assert rng.seed_state(2, 3) == (3, 1, 4, 1, 1)
    assert constants(2, 3) == (7111014902169325161, 3043718919927570188)


def test_skip_is_many_steps():
    state = stepped = rng.seed_state(5, 9)
    for _ in range(300):
        _, stepped = rng.draw(stepped)
    assert rng.skip(state, 0, 0, 300) == stepped
    assert rng.skip(rng.skip(state, 1, 2, 3), 4, 5, 6) == rng.skip(state, 5, 7, 9)


def test_vector_form_agrees():
    ids = np.array([0, 1, 255, 256, 70000, 1 << 40])
    state = rng.seed_state(2, 3)
    many = rng.states_at(state, ids)
    assert [tuple(map(int, row)) for row in many] == [rng.skip(state, 0, int(i), 0) for i in ids]
    draws = rng.next_draw(many)
    assert [int(d) for d in draws] == [rng.draw(rng.skip(state, 0, int(i), 0))[0] for i in ids]


def test_reverse_bits():
    for x in [0, 1, 2, 0x8000000000000000, random.getrandbits(64)]:
        assert int(reverse_bits(np.array([x], np.uint64))[0]) == int(f"{x:064b}"[::-1], 2)


@pytest.mark.parametrize("scale", [1, 4, 9])
def test_scramble_is_a_permutation(scale):
    out = scramble(np.arange(1 << scale), scale, constants(2, 3))
    assert sorted(out.tolist()) == list(range(1 << scale))


@pytest.mark.parametrize("scale", SUMS)
def test_golden_sums(scale):
    v0, v1 = edge_arrays(EdgeSpec(scale), np.arange(16 << scale))
    kept = {(min(a, b), max(a, b)) for a, b in zip(v0.tolist(), v1.tolist()) if a != b}
    assert ((v0 == v1).sum(), len(kept), v0.sum(), v1.sum()) == SUMS[scale]


@pytest.mark.parametrize("scale", FIRST)
def test_golden_first_edges(scale):
    v0, v1 = edge_arrays(EdgeSpec(scale), np.arange(3))
    assert list(zip(v0.tolist(), v1.tolist())) == FIRST[scale]


def test_other_profiles():
    assert edge_arrays(EdgeSpec(8, a=5500, bc=100), np.arange(2))[1].tolist() == [120, 212]
    assert edge_arrays(EdgeSpec(8, initial="tree"), np.arange(4))[0].tolist() == [231, 50, 153, 57]
    assert edge_arrays(EdgeSpec(8, kind="uniform"), np.arange(3))[0].tolist() == [12, 137, 234]
    weights = edge_arrays(EdgeSpec(6, weighted=True), np.arange(1024))[2]
    assert weights.min() >= 1 and weights.max() <= 255


def test_partitioning_does_not_matter(spark):
    one, many = (edges(spark, EdgeSpec(6), p).orderBy("edge_id").collect() for p in (1, 7))
    assert one == many and len(one) == 1024


def test_traversed_edges(spark):
    from wavefront.operators import graph, traverse, validate

    for scale in (6, 8, 10):
        raw = kronecker_edges(spark, scale).persist()
        adj = graph.adjacency(raw).persist()
        root = adj.agg({"src": "min"}).first()[0]
        ok, n, failed = validate.validate(raw, traverse.bfs(adj, root).tree, root, 1 << scale)
        assert (ok, n, failed) == (True, TRAVERSED[scale], [])
