"""Deterministic random edge tables.

Edge i is a function of i and the seeds alone: its random numbers begin
``i * 2^64`` steps into the stream. So any number of tasks makes the same
table, and a lost task makes its rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.rng import next_draw, seed_state, states_at
from ..functions.scramble import constants, scramble
from ..schema import NUMBERED_EDGES, WEIGHTED_EDGES

# Fixed values of the benchmark: denominators, the limit of redrawn values, seeds, profiles.
DENOMINATOR = 10000
REDRAWN = 0xFFFFFFFF % DENOMINATOR
SEED1, SEED2 = 2, 3
PROFILE_2010 = {"a": 5700, "bc": 1900, "initial": "none", "weighted": False}
PROFILE_2012 = {"a": 5500, "bc": 100, "initial": "tree", "weighted": True}
MAX_WEIGHT = 255
EDGE_FACTOR = 16


@dataclass(frozen=True)
class EdgeSpec:
    """What names an edge table. ``kind``: kronecker or uniform; ``initial``: none, tree or cycle."""

    scale: int
    edge_factor: int = EDGE_FACTOR
    kind: str = "kronecker"
    a: int = 5700
    bc: int = 1900
    initial: str = "none"
    weighted: bool = False
    max_weight: int = MAX_WEIGHT
    seed1: int = SEED1
    seed2: int = SEED2

    @property
    def vertices(self) -> int:
        return 1 << self.scale

    @property
    def initial_edges(self) -> int:
        return {"none": 0, "tree": self.vertices - 1, "cycle": self.vertices}[self.initial]

    @property
    def edges(self) -> int:
        return self.vertices * self.edge_factor + self.initial_edges

    @property
    def raw_gigabytes(self) -> float:
        return self.edges * 16 / 1e9


def _initial(spec: EdgeSpec, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if spec.initial == "tree":
        return at + 1, (at + 1) // 2
    return at, (at + 1) % spec.vertices


def _uniform(spec: EdgeSpec, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(spec.vertices - 1)
    first = next_draw(states) & mask
    return first, next_draw(states) & mask


def _kronecker(spec: EdgeSpec, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level by level all edges choose a quadrant; while both ends agree, the lower triangle is flipped up."""
    src, dst = np.zeros(len(states), np.int64), np.zeros(len(states), np.int64)
    for level in range(spec.scale):
        value = next_draw(states)
        while (again := np.nonzero(value < REDRAWN)[0]).size:
            some = states[again]
            value[again] = next_draw(some)
            states[again] = some
        value %= DENOMINATOR
        quadrant = np.select([value < spec.bc, value < 2 * spec.bc, value < 2 * spec.bc + spec.a], [1, 2, 0], 3)
        quadrant[(src == dst) & (quadrant == 2)] = 1
        half = 1 << (spec.scale - 1 - level)
        src += half * (quadrant // 2)
        dst += half * (quadrant % 2)
    return src, dst


def edge_arrays(spec: EdgeSpec, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(v0, v1) or (v0, v1, weight) of the edges with these numbers."""
    seed, values = seed_state(spec.seed1, spec.seed2), constants(spec.seed1, spec.seed2)
    v0, v1 = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    first = ids < spec.initial_edges
    v0[first], v1[first] = _initial(spec, ids[first])
    states = states_at(seed, ids[~first])
    make = _uniform if spec.kind == "uniform" else _kronecker
    v0[~first], v1[~first] = make(spec, states)
    out = scramble(v0, spec.scale, values), scramble(v1, spec.scale, values)
    if not spec.weighted:
        return out
    # the weight stream starts at (30, 46) and moves one step for each edge
    start = skip_to_weights(seed)
    weights = next_draw(states_at(start, ids, first_byte=0)) % np.uint64(spec.max_weight) + np.uint64(1)
    return *out, weights.astype(np.int32)


def skip_to_weights(seed: tuple[int, ...]) -> tuple[int, ...]:
    from ..functions.rng import skip

    return skip(seed, 30, 46, 0)


def edges(spark: SparkSession, spec: EdgeSpec, partitions: int | None = None) -> DataFrame:
    """(edge_id, v0, v1[, weight]) for a whole specification, made where it is needed."""
    schema = WEIGHTED_EDGES if spec.weighted else NUMBERED_EDGES

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, edge_arrays(spec, ids))], schema.names)

    per_task = 1 << 18
    parts = partitions or max(1, min(200_000, -(-spec.edges // per_task)))
    return spark.range(0, spec.edges, 1, parts).mapInArrow(make, schema)


def kronecker_edges(spark: SparkSession, scale: int, edge_factor: int = EDGE_FACTOR, profile: dict | None = None, **more: int) -> DataFrame:
    return edges(spark, EdgeSpec(scale, edge_factor, **(profile or PROFILE_2010), **more))


def uniform_edges(spark: SparkSession, scale: int, edge_factor: int = EDGE_FACTOR, **more: int) -> DataFrame:
    return edges(spark, EdgeSpec(scale, edge_factor, kind="uniform", **more))
