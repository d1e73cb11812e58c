"""Where vertices and edges live on a grid of R x C members, and how even that is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(members: int) -> tuple[int, int]:
    """Rows and columns of the most square grid, with no more rows than columns."""
    rows = max(r for r in range(1, math.isqrt(members) + 1) if members % r == 0)
    return rows, members // rows


def vertex_owner(v: Column, rows: int, columns: int) -> Column:
    return F.pmod(v, F.lit(rows * columns))


def vertex_local(v: Column, rows: int, columns: int) -> Column:
    return F.floor(v / (rows * columns)).cast("long")


def owner_row(v: Column, rows: int) -> Column:
    return F.pmod(v, F.lit(rows))


def owner_column(v: Column, rows: int, columns: int) -> Column:
    return F.pmod(F.floor(v / rows).cast("long"), F.lit(columns))


def edge_owner(v0: Column, v1: Column, rows: int, columns: int) -> Column:
    return owner_row(v0, rows) + owner_column(v1, rows, columns) * rows


def to_destination(v: Column, rows: int, columns: int, bits: int) -> Column:
    """The id by which a column of the grid names a vertex: the owner's row, and the number within the owner."""
    return F.shiftleft(owner_row(v, rows), bits).bitwiseOR(vertex_local(v, rows, columns))


def to_source(v: Column, rows: int, columns: int, bits: int) -> Column:
    """The id by which a row of the grid names a vertex: the owner's column, and the number within the owner."""
    return F.shiftleft(owner_column(v, rows, columns), bits).bitwiseOR(vertex_local(v, rows, columns))


def _low(s: Column, bits: int) -> Column:
    return s.bitwiseAND(F.lit((1 << bits) - 1))


def from_destination(d: Column, column: Column, rows: int, columns: int, bits: int) -> Column:
    """The vertex of a destination id in a column of the grid."""
    return _low(d, bits) * (rows * columns) + F.shiftright(d, bits) + column * rows


def from_source(s: Column, row: Column, rows: int, columns: int, bits: int) -> Column:
    """The vertex of a source id in a row of the grid."""
    return _low(s, bits) * (rows * columns) + row + F.shiftright(s, bits) * rows


def source_to_destination(s: Column, row: Column, bits: int) -> Column:
    return F.shiftleft(row.cast("long"), bits).bitwiseOR(_low(s, bits))


def destination_to_source(d: Column, column: Column, bits: int) -> Column:
    return F.shiftleft(column.cast("long"), bits).bitwiseOR(_low(d, bits))


def largest_part(frontier: DataFrame, members: int) -> DataFrame:
    """One row: the vertices of a frontier, and the most that one member owns."""
    owned = frontier.groupBy(F.pmod("vertex", F.lit(members)).alias("owner")).agg(F.count("*").alias("n"))
    return owned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def redistribute(edges: DataFrame, rows: int, columns: int) -> DataFrame:
    """Edges dealt out by their place on the grid; a weight column goes along.

    As many tasks share a member as the session has partitions for it, one at least;
    else the edges of a member, or of several, would all have to pass through one.
    """
    members = rows * columns
    shares = -(-int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // members)
    placed = edges.withColumn("owner", edge_owner(F.col("v0"), F.col("v1"), rows, columns))
    return placed.repartition(members * shares, "owner", F.pmod(F.xxhash64("v0", "v1"), F.lit(shares)))


def swizzle(v: Column, members: int, bits: int) -> Column:
    """Owner in the high bits, number within the owner in the low ones."""
    return F.shiftleft(F.pmod(v, F.lit(members)), bits).bitwiseOR(F.floor(v / members).cast("long"))


def unswizzle(s: Column, members: int, bits: int) -> Column:
    return s.bitwiseAND(F.lit((1 << bits) - 1)) * members + F.shiftright(s, bits)


def partition_sizes(edges: DataFrame, rows: int, columns: int) -> DataFrame:
    """Edges by owner, and how much more than the mean that is, in per cent."""
    sizes = edges.groupBy(edge_owner(F.col("v0"), F.col("v1"), rows, columns).alias("owner")).agg(F.count("*").alias("n"))
    mean = sizes.agg((F.sum("n") / F.lit(rows * columns)).alias("mean"))
    return sizes.crossJoin(F.broadcast(mean)).select("owner", "n", F.round((F.col("n") - F.col("mean")) / F.col("mean") * 100, 6).alias("imbalance"))  # one row


def task_sizes(df: DataFrame) -> DataFrame:
    """Total, mean and largest number of rows of the tasks that hold ``df``."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count()
    return sizes.agg(F.sum("count").alias("total"), F.avg("count").alias("mean"), F.max("count").alias("largest"))


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` with what ``right`` has for their key, or nulls."""
    return left.join(right, key, "left")
