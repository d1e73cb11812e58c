"""Structured Streaming over folders of edge files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import EDGES


def ingest_edges(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the edges of new Parquet files in ``source`` to ``sink``, exactly once, and stops."""
    edges = spark.readStream.schema(EDGES).parquet(source)
    return edges.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_counts(edges: DataFrame) -> DataFrame:
    """Running multigraph degrees of a stream of edges; loops don't count."""
    ends = edges.where("v0 <> v1").select(F.explode(F.array("v0", "v1")).alias("vertex"))
    return ends.groupBy("vertex").agg(F.count("*").alias("degree"))
