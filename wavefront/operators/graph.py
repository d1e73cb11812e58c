"""From raw edges to an adjacency table, and what is counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import durable


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("v0 <> v1")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge that is no loop; one scan, no shuffle."""
    ends = F.explode(F.array(F.struct(F.col("v0").alias("src"), F.col("v1").alias("dst")), F.struct(F.col("v1").alias("src"), F.col("v0").alias("dst"))))
    return without_loops(edges).select(ends.alias("e")).select("e.src", "e.dst")


def merged(edges: DataFrame) -> DataFrame:
    """Edges without loops and repeats, each once, the lesser end first."""
    return without_loops(edges).select(F.least("v0", "v1").alias("v0"), F.greatest("v0", "v1").alias("v1")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Symmetric edges without repeats.

    Repeats are merged while an edge is one row; so half as many rows go
    through the shuffle as with both directions.
    """
    return symmetrize(merged(edges))


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    """The adjacency, dealt out by source and sorted in each task: compressed sparse rows as a table."""
    return adjacency(edges).repartition("src").sortWithinPartitions("src", "dst")


def neighbor_lists(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def degrees(edges: DataFrame) -> DataFrame:
    """Multigraph degree at both ends, without loops."""
    return symmetrize(edges).groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def dedup_reduction(edges: DataFrame) -> DataFrame:
    """Directed edges before and after merging repeats, and the saving in per cent."""
    pairs = without_loops(edges).select(F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b")).groupBy("a", "b").count()
    raw, kept = F.coalesce(F.sum("count"), F.lit(0)) * 2, F.count("*") * 2
    return pairs.agg(raw.alias("raw"), kept.alias("kept")).select("raw", "kept", F.round((F.col("raw") - F.col("kept")) * 100.0 / F.col("raw"), 6).alias("pct"))


def degree_histogram(edges: DataFrame, shift: int = 16) -> DataFrame:
    """Directed edges by the high bits of their source."""
    return symmetrize(edges).groupBy(F.shiftright("src", shift).alias("bucket")).agg(F.count("*").alias("n"))


def scale_estimate(edges: DataFrame) -> DataFrame:
    """The bits that occur in any id, and how many low bits ids take."""
    seen = edges.agg(F.coalesce(F.bit_or(F.col("v0").bitwiseOR(F.col("v1"))), F.lit(0)).alias("or_value"))
    return seen.select("or_value", F.when(F.col("or_value") == 0, 0).otherwise(F.length(F.bin("or_value"))).cast("int").alias("scale"))


def vertices(edges: DataFrame) -> DataFrame:
    """Vertices with an edge that is no loop."""
    return without_loops(edges).select(F.explode(F.array("v0", "v1")).alias("vertex")).distinct()


def num_vertices(edges: DataFrame) -> DataFrame:
    return vertices(edges).agg(F.count("*").alias("n"))


def max_used_vertex(edges: DataFrame) -> DataFrame:
    return without_loops(edges).agg(F.max(F.greatest("v0", "v1")).alias("n"))


def max_weight(edges: DataFrame) -> DataFrame:
    top = F.coalesce(F.max("weight"), F.lit(0))
    return edges.agg(top.alias("max_weight")).select("max_weight", F.when(F.col("max_weight") > 0, F.length(F.bin("max_weight"))).otherwise(0).cast("int").alias("bits"))


def isolated(edges: DataFrame, domain: DataFrame) -> DataFrame:
    """Those of ``domain`` (vertex) that have no edge, or loops only."""
    return domain.join(vertices(edges), "vertex", "left_anti")


def has_edge(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    known = vertices(edges).withColumn("known", F.lit(True))
    return candidates.join(known, "vertex", "left").select("vertex", F.coalesce("known", F.lit(False)).alias("has_edge"))


def lists_of(vertex: Column, members: int) -> Column:
    return F.pmod(vertex, F.lit(members))


def dense_numbers(df: DataFrame, part: str, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with a number from 0 without gaps in each ``part``, in the order of ``order`` (unique there).

    Rows are dealt out by ranges of part and order, so any number of tasks
    shares a part; each numbers its own rows, and only the tasks' counts are
    summed in order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.repartitionByRange(parts, part, *order).withColumn("pid_", F.spark_partition_id()))
    counts = dealt.groupBy(part, "pid_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(part).orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, "pid_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    own = F.row_number().over(Window.partitionBy(part, "pid_").orderBy(*order))
    return dealt.withColumn(name, own).join(starts, [part, "pid_"]).withColumn(name, (F.col("base_") + F.col(name) - 1).cast("long")).drop("pid_", "base_")


def reorder_by_degree(edges: DataFrame, members: int) -> DataFrame:
    """New dense ids within each of ``members`` parts, by falling degree and then id."""
    rows = degrees(edges).withColumn("part", lists_of(F.col("vertex"), members))
    return dense_numbers(rows, "part", [F.desc("degree"), "vertex"], "new_id").select("vertex", "part", "new_id")


def reorder_nonzero(edges: DataFrame, members: int) -> DataFrame:
    """New dense ids within each part for vertices with an edge, in the order of ids."""
    rows = vertices(edges).withColumn("part", lists_of(F.col("vertex"), members))
    return dense_numbers(rows, "part", ["vertex"], "new_id").select("vertex", "part", "new_id")


def reorder_identity(edges: DataFrame, members: int) -> DataFrame:
    """Each vertex with an edge under its own number within its part."""
    part = lists_of(F.col("vertex"), members)
    return vertices(edges).select("vertex", part.alias("part"), F.floor(F.col("vertex") / members).cast("long").alias("new_id"))


def inverse_map(reordered: DataFrame) -> DataFrame:
    """From a part's new id back to the vertex."""
    return reordered.select("part", "new_id", "vertex")


def max_local_vertices(reordered: DataFrame) -> DataFrame:
    return reordered.agg((F.max("new_id") + 1).alias("n"))


def relabel(adj: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends replaced by ``new_id`` of a mapping (vertex, new_id)."""
    one = mapping.select(F.col("vertex").alias("src"), F.col("new_id").alias("new_src"))
    two = mapping.select(F.col("vertex").alias("dst"), F.col("new_id").alias("new_dst"))
    return adj.join(one, "src").join(two, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def running_total(df: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``key`` (unique).

    Rows are dealt out by ranges of the key. Each task sums its own rows; only
    the tasks' totals are summed in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.repartitionByRange(parts, key).withColumn("pid_", F.spark_partition_id()))
    before = Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("pid_").agg(F.sum(value).alias("s_")).select("pid_", F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("base_"))
    own = Window.partitionBy("pid_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(total, F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(base), "pid_").withColumn(total, F.col(total) + F.col("base_")).drop("pid_", "base_")


def csr_offsets(adj: DataFrame) -> DataFrame:
    """Where each vertex's neighbours begin and end in the sorted adjacency."""
    rows = adj.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("n"))
    return running_total(rows, "vertex", "n", "row_start").select("vertex", "row_start", (F.col("row_start") + F.col("n")).alias("row_end"))


def first_edges(adj: DataFrame) -> DataFrame:
    """The least neighbour of each vertex: a grouped minimum, without a sort."""
    return adj.groupBy("src").agg(F.min("dst").alias("dst"))


def remaining_edges(adj: DataFrame) -> DataFrame:
    least = first_edges(adj).withColumnRenamed("dst", "least")
    return adj.join(least, "src").where("dst <> least").select("src", "dst")


def bitmap(df: DataFrame, column: str = "vertex") -> DataFrame:
    """A set of non-negative ids as bit maps of 32,768 places; bucket b begins at id 32768 (b - 1)."""
    place = F.col(column) + 1  # Spark's first bucket begins at 1
    return df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def bitmap_members(maps: DataFrame) -> DataFrame:
    """The ids of bit maps."""
    byte = F.transform(F.sequence(F.lit(1), F.octet_length("bits")), lambda k: F.struct(k.alias("k"), F.hex(F.substring(F.col("bits"), k, F.lit(1))).alias("x")))
    some = maps.select("bucket", F.explode(F.filter(byte, lambda s: s.x != "00")).alias("s")).select("bucket", "s.k", F.conv("s.x", 16, 10).cast("int").alias("x"))
    bit = F.explode(F.array(*[F.when(F.col("x").bitwiseAND(F.lit(1 << i)) != 0, F.lit(i)) for i in range(8)])).alias("i")
    return some.select("bucket", "k", bit).where("i IS NOT NULL").select(((F.col("bucket") - 1) * 32768 + (F.col("k") - 1) * 8 + F.col("i")).cast("long").alias("vertex"))
