"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At a node every child draws
``-ln(u) / weight`` with u from a hash of the key and the child's name, and the
least draw wins; a child's weight is the sum of the weights of its shards. The
draws of the other children don't depend on a child's weight. So a change of
weights moves keys only into subtrees that gained weight and out of subtrees
that lost some, and a new region takes keys into itself only.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HIDDEN, durable

#: {region: {rack: {shard number: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Tree:
    """Shards of weight one dealt over regions and racks; empty parts are left out."""
    tree: Tree = {}
    for s in range(shards):
        place = s * regions * racks // shards
        tree.setdefault(f"region{place // racks}", {}).setdefault(f"rack{place % racks}", {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a region of its own."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"region+{new}": {"rack0": {new: weight}}}


def _levels(tree: Tree) -> dict:
    """Nested {name: (weight, children or shard number)}, without weights of zero."""
    out = {}
    for region, racks in tree.items():
        inner = {}
        for rack, shards in racks.items():
            leaves = {f"{region}/{rack}/{s}": (w, s) for s, w in shards.items() if w > 0}
            if leaves:
                inner[f"{region}/{rack}"] = (sum(w for w, _ in leaves.values()), leaves)
        if inner:
            out[region] = (sum(w for w, _ in inner.values()), inner)
    return out


def shard_of(key: str, tree: Tree) -> int:
    """The shard of one key, in plain Python; ``shard_column`` says the same."""
    below = _levels(tree)
    while True:
        draws = []
        for name, (weight, inside) in below.items():
            u = ((xxhash.xxh64_intdigest(f"{key}/{name}", 42) >> 11) + 1) / 2.0**53
            draws.append((-math.log(u) / weight, name, inside))
        below = min(draws)[2]
        if isinstance(below, int):
            return below


def shard_column(key: Column, tree: Tree) -> Column:
    """The shard of a key (a string) as an expression."""

    def choose(below: dict) -> Column:
        draws, results = [], {}
        for name, (weight, inside) in below.items():
            u = (F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"/{name}"))), 11) + 1).cast("double") / 2.0**53
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(name).alias("n")))
            results[name] = F.lit(inside) if isinstance(inside, int) else choose(inside)
        if len(draws) == 1:
            return next(iter(results.values()))
        winner = F.least(*draws).getField("n")
        out = None
        for name, result in results.items():
            out = F.when(winner == name, result) if out is None else out.when(winner == name, result)
        return out

    return choose(_levels(tree)).cast("int")


def assign(df: DataFrame, tree: Tree, id_col: str = "doc_id", new_tree: Tree | None = None, shard: str = "shard", new_shard: str = "grown_shard") -> DataFrame:
    """``df`` with the shard of each row, and where it goes under ``new_tree``.

    The id alone decides: rows of one id share a shard, null ids go where the
    empty text goes. Columns with the names of added ones are replaced. No
    shuffle; an empty table stays empty.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return df.withColumns({shard: shard_column(key, tree), new_shard: shard_column(key, new_tree) if new_tree else F.lit(None).cast("int")})


def with_slots(df: DataFrame, order: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with a number from 0 without gaps in each shard, in the order of ``order``.

    Rows are dealt out by range, so any number of tasks shares a shard, however
    many rows have the same values; each task counts its rows, and only these
    counts are summed up in order. Equal rows are numbered in any order, nulls
    come first; a null shard is a shard like any other. A column with the name
    of the added one is replaced. An empty table stays empty.
    """
    pid, uid, base = f"{HIDDEN}pid", f"{HIDDEN}uid", f"{HIDDEN}base"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.withColumn(uid, F.monotonically_increasing_id())
    dealt = durable(tagged.repartitionByRange(parts, shard, *order, uid).withColumn(pid, F.spark_partition_id()))
    counts = dealt.groupBy(shard, pid).agg(F.count("*").alias(base))
    before = Window.partitionBy(shard).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, pid, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    own = F.row_number().over(Window.partitionBy(shard, pid).orderBy(*order, uid))
    return dealt.withColumn(slot, own).join(starts, [shard, pid]).withColumn(slot, F.col(base) + F.col(slot) - 1).drop(pid, uid, base)
