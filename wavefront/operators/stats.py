"""Order statistics of runs, rates, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVEN = ["min", "q1", "median", "q3", "max", "mean", "std"]


def seven_numbers(df: DataFrame, column: str) -> DataFrame:
    """(metric, value): extremes, quartiles, mean and sample deviation of one column.

    A quartile is the mean of the two places that integer division gives from
    below and from above, not an interpolated percentile. Meant for run logs:
    values are ranked in one place. Nulls don't count.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ranked = values.select("x", (F.row_number().over(Window.orderBy("x")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    n = F.max("n")

    def at(place: str) -> Column:
        return F.max(F.expr(f"CASE WHEN i = {place} THEN x END"))

    wide = ranked.agg(
        F.min("x").alias("min"), ((at("(n - 1) div 4") + at("n div 4")) / 2).alias("q1"), ((at("(n - 1) div 2") + at("n div 2")) / 2).alias("median"),
        ((at("n - 1 - (n - 1) div 4") + at("n - 1 - n div 4")) / 2).alias("q3"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), n.alias("n"),
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in SEVEN])
    return wide.where("n > 0").select(F.explode(pairs).alias("p")).select("p.*")


def teps_report(runs: DataFrame, time: str = "bfs_time", edges: str = "edge_count") -> DataFrame:
    """(metric, value) of traversed edges per second.

    From the statistics of time per edge: rates swap extremes and quartiles,
    the mean becomes the harmonic mean, and its deviation follows from it.
    """
    per_edge = seven_numbers(runs.select((F.col(time) / F.col(edges)).alias("x")), "x")
    wide = per_edge.groupBy().pivot("metric", SEVEN).agg(F.first("value"))
    n = runs.where(F.col(time).isNotNull() & F.col(edges).isNotNull()).agg(F.count("*").alias("n"))
    wide = wide.crossJoin(n)  # of one row and one row
    rates = [
        ("min", "1 / max"), ("q1", "1 / q3"), ("median", "1 / median"), ("q3", "1 / q1"), ("max", "1 / min"),
        ("harmonic_mean", "1 / mean"), ("harmonic_std", "CASE WHEN n > 1 THEN std / (mean * mean * sqrt(n - 1)) END"),
    ]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in rates])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def profile_summary(profile: DataFrame) -> DataFrame:
    """Sum, mean and maximum over processes of each metric and level."""
    return profile.groupBy("metric", "level").agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.max("value").alias("max"))


def slowest(progress: DataFrame, n: int = 8) -> DataFrame:
    """The processes that are least far."""
    return progress.orderBy("progress", "process").limit(n)


def level_rates(levels: DataFrame, vertices: int, edges: int) -> DataFrame:
    """Shares in per cent of new and unvisited vertices, and of relaxed edges, by level."""
    return levels.select("level", (F.col("nq") * 100.0 / vertices).alias("nq_rate"), (F.col("unvisited") * 100.0 / vertices).alias("unvisited_rate"), (F.col("relaxed") * 100.0 / edges).alias("relax_rate"))
