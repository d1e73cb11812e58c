"""Edge tables: files, edges of ordinary tables, and storage of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import durable
from ..schema import EDGES


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines_of_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with their order; the orders of a partition are hashed, so that the lines need no sort."""
    return lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey)


def customer_part(spark: SparkSession, folder: str) -> DataFrame:
    """Customers (even ids) to the parts (odd ids) that they ordered."""
    lines, orders = _table(spark, folder, "lineitem"), _table(spark, folder, "orders")
    return _lines_of_orders(lines, orders).select((F.col("o_custkey") * 2).cast("long").alias("v0"), (F.col("l_partkey") * 2 + 1).cast("long").alias("v1"))


def returned_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The part of :func:`customer_part` for returned lines with little discount: sparse and deep."""
    lines = _table(spark, folder, "lineitem").where("l_returnflag = 'R' AND l_discount < 0.02")
    orders = _table(spark, folder, "orders")
    return _lines_of_orders(lines, orders).select((F.col("o_custkey") * 2).cast("long").alias("v0"), (F.col("l_partkey") * 2 + 1).cast("long").alias("v1"))


def nation_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Nation of the customer to nation of the supplier, once for each order line."""
    lines, orders = _table(spark, folder, "lineitem"), _table(spark, folder, "orders")
    customers, suppliers = _table(spark, folder, "customer"), _table(spark, folder, "supplier")
    joined = _lines_of_orders(lines, orders).join(customers, orders.o_custkey == customers.c_custkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.select(F.col("c_nationkey").cast("long").alias("v0"), F.col("s_nationkey").cast("long").alias("v1"))


def user_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's user to the user of the next event in time.

    Events are dealt out by time range; a task pairs its own neighbours, and
    only the first and last event of each task are paired between tasks.
    """
    events = _table(spark, folder, "events").select("ts", "event_id", F.col("user_id").cast("long").alias("user_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(events.repartitionByRange(parts, "ts", "event_id").withColumn("pid", F.spark_partition_id()))  # read twice, with the same ranges
    ordered = Window.partitionBy("pid").orderBy("ts", "event_id")
    rows = dealt.withColumn("next_user", F.lead("user_id").over(ordered)).withColumn("place", F.row_number().over(ordered))
    inside = rows.where("next_user IS NOT NULL").select(F.col("user_id").alias("v0"), F.col("next_user").alias("v1"))
    ends = dealt.groupBy("pid").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    between = ends.select("last", F.lead("first").over(Window.orderBy("pid")).alias("first")).where("first IS NOT NULL")  # one row for each task
    return inside.unionByName(between.select(F.col("last").alias("v0"), F.col("first").alias("v1")))


TABLE_GRAPHS = {"G1": customer_part, "G2": nation_nation, "G3": user_sequence, "G4": returned_parts}


def edges_from_tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return TABLE_GRAPHS[name](spark, folder)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(path)


def write_edges(edges: DataFrame, path: str, append: bool = False) -> None:
    """Writes a new folder, or adds files to one."""
    edges.write.mode("append" if append else "errorifexists").parquet(path)
