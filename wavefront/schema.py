"""The tables that stages hand to each other."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Raw undirected multigraph, each edge in one direction; loops and repeats allowed.
EDGES = _schema(v0=T.LongType(), v1=T.LongType())
NUMBERED_EDGES = _schema(edge_id=T.LongType(), v0=T.LongType(), v1=T.LongType())
WEIGHTED_EDGES = _schema(edge_id=T.LongType(), v0=T.LongType(), v1=T.LongType(), weight=T.IntegerType())
#: Symmetric, without repeats and loops.
ADJACENCY = _schema(src=T.LongType(), dst=T.LongType())
#: Search result; a vertex that was not reached has no row.
TREE = _schema(vertex=T.LongType(), parent=T.LongType(), depth=T.IntegerType())
LEVELS = _schema(level=T.IntegerType(), direction=T.StringType(), nq=T.LongType(), visited=T.LongType(), unvisited=T.LongType(), relaxed=T.LongType())
RUNS = _schema(run_id=T.IntegerType(), root=T.LongType(), bfs_time=T.DoubleType(), validate_time=T.DoubleType(), edge_count=T.LongType())
RUN_HEADER = _schema(
    scale=T.IntegerType(), edge_factor=T.IntegerType(), workers=T.IntegerType(), num_runs=T.IntegerType(),
    generation_time=T.DoubleType(), construction_time=T.DoubleType(), redistribution_time=T.DoubleType(),
)
PROFILE = _schema(metric=T.StringType(), level=T.IntegerType(), process=T.IntegerType(), value=T.DoubleType())
