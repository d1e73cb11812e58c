"""The log of a benchmark: one row for each root, and a header.

A run that was stopped goes on after the last root in the log, if the header
says that it is the same benchmark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RUN_HEADER, RUNS

# Fixed values of the binary layout: integers and reals of the header, reals of a run, most runs.
HEADER_FIELDS = "4i3d"
RUN_FIELDS = "2dq"
MOST_RUNS = 64
#: What must agree for a run to go on where a log ends.
SAME = ("scale", "edge_factor", "workers")


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/runs", RUNS)


def read_header(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/header", RUN_HEADER)


def write_header(spark: SparkSession, folder: str, **values: float) -> None:
    row = tuple(values.get(f.name) for f in RUN_HEADER)
    spark.createDataFrame([row], RUN_HEADER).write.mode("overwrite").parquet(f"{folder}/header")


class OtherBenchmark(ValueError):
    """The folder holds the log of a benchmark with other parameters."""


def open_log(spark: SparkSession, folder: str, **values: float) -> None:
    """Writes the header of a new log; refuses a log whose scale, edge factor or workers differ, or that has runs but no header."""
    header = read_header(spark, folder).first()  # one row at most
    if header is None:
        if not read_runs(spark, folder).isEmpty():
            raise OtherBenchmark(f"{folder} has runs but no header")
        write_header(spark, folder, **values)
        return
    for name in SAME:
        if header[name] != values.get(name):
            raise OtherBenchmark(f"the log in {folder} is of {name} {header[name]}, this run of {values.get(name)}")


def append_run(spark: SparkSession, folder: str, run_id: int, root: int, bfs_time: float, validate_time: float, edge_count: int) -> None:
    """Adds one file; what is there is never written again."""
    spark.createDataFrame([(run_id, root, bfs_time, validate_time, edge_count)], RUNS).coalesce(1).write.mode("append").parquet(f"{folder}/runs")


def next_run(runs: DataFrame, header: DataFrame | None = None, **same: int) -> DataFrame:
    """One row ``next_run``: where to go on; 0 if there is no log, or one of another benchmark."""
    last = runs.agg((F.coalesce(F.max("run_id"), F.lit(-1)) + 1).cast("int").alias("n"))
    if header is None:
        return last.select(F.col("n").alias("next_run"))
    fits = F.lit(True)
    for name, value in same.items():
        fits = fits & (F.col(name) == value)
    agrees = header.where(fits).agg((F.count("*") > 0).alias("ok"))
    return last.crossJoin(agrees).select(F.when(F.col("ok"), F.col("n")).otherwise(0).cast("int").alias("next_run"))  # of one row and one row


def parse_binary(data: bytes) -> tuple[tuple, list[tuple[float, float, int]]]:
    """Header and runs of the binary layout, in either byte order.

    A record with an impossible number of runs is of the other byte order.
    """
    for order in "<>":
        header = struct.unpack_from(order + HEADER_FIELDS, data)
        if 0 <= header[3] <= MOST_RUNS:
            break
    else:
        raise ValueError("not a run log")
    at, size = struct.calcsize(order + HEADER_FIELDS), struct.calcsize(order + RUN_FIELDS)
    return header, [struct.unpack_from(order + RUN_FIELDS, data, at + i * size) for i in range(header[3])]


def write_binary(header: tuple, runs: list[tuple[float, float, int]], order: str = "<") -> bytes:
    body = b"".join(struct.pack(order + RUN_FIELDS, *r) for r in runs)
    return struct.pack(order + HEADER_FIELDS, *header) + body.ljust(MOST_RUNS * struct.calcsize(order + RUN_FIELDS), b"\0")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, scale, edge_factor, workers, num_runs, run_id, bfs_time, validate_time, edge_count) of binary logs."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"]):
                header, runs = parse_binary(bytes(content))
                rows += [(name, *header[:4], i, t, tv, int(e)) for i, (t, tv, e) in enumerate(runs)]
            yield pd.DataFrame(rows, columns=["path", "scale", "edge_factor", "workers", "num_runs", "run_id", "bfs_time", "validate_time", "edge_count"])

    schema = "path string, scale int, edge_factor int, workers int, num_runs int, run_id int, bfs_time double, validate_time double, edge_count long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)
