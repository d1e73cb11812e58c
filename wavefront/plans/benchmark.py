"""The whole benchmark: generate, build, search from many roots, validate, report."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import reals
from ..operators import exchange, graph, stats, traverse
from ..operators import validate as checks
from ..schema import PROFILE, RUNS
from ..sources import runlog
from ..sources.kronecker import EdgeSpec, edges

log = logging.getLogger(__name__)

# Roots of a full run and of a test run; validation of none, the first, all.
ROOTS, TEST_ROOTS = 64, 16
VALIDATE_NONE, VALIDATE_FIRST, VALIDATE_ALL = 0, 1, 2
#: Traversed edges by scale with edge factor 16 and seeds 2 and 3.
TRAVERSED = {
    6: 1024, 8: 4096, 10: 16383, 12: 65535, 14: 262144, 16: 1048570, 18: 4194250, 20: 16776976, 22: 67108130,
}


@dataclass
class Settings:
    spec: EdgeSpec
    roots: int = TEST_ROOTS
    direction: str = "hybrid"
    validation: int = VALIDATE_ALL
    members: int = 4
    log_folder: str | None = None
    spill_folder: str | None = None
    warm_up_s: float = 0.0


@dataclass
class Report:
    settings: Settings
    seconds: dict[str, float] = field(default_factory=dict)
    runs: list[tuple] = field(default_factory=list)
    levels: list[dict] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    vertices: int = 0
    max_vertex: int = 0

    @property
    def valid(self) -> bool:
        return not self.failed

    def runs_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.runs, RUNS)

    def profile_df(self, spark: SparkSession) -> DataFrame:
        rows = [(f"{level['direction']}_nq", level["level"], 0, float(level["nq"])) for level in self.levels]
        return spark.createDataFrame(rows, PROFILE)


def kronecker_roots(adj: DataFrame, spec: EdgeSpec, wanted: int) -> list[int]:
    """The roots that the benchmark's random numbers name."""

    def draw(i: int) -> int:
        a, b = reals(2, spec.seed1, spec.seed2, 2 * i)
        return int((a + b) * spec.vertices) % spec.vertices

    def with_edges(some: list[int]) -> set[int]:
        return {r["src"] for r in adj.where(F.col("src").isin(sorted(set(some)))).select("src").distinct().collect()}  # a batch at most

    return traverse.find_roots(draw, with_edges, spec.vertices, wanted)


def prepare(spark: SparkSession, settings: Settings, report: Report) -> tuple[DataFrame, traverse.Layout]:
    """Raw edges and adjacency, both kept; the times go to the report."""
    start = time.perf_counter()
    raw = edges(spark, settings.spec).select("v0", "v1")
    if settings.spill_folder:
        raw.write.mode("overwrite").parquet(f"{settings.spill_folder}/edges")
        raw = spark.read.parquet(f"{settings.spill_folder}/edges")
    else:
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    raw.count()
    report.seconds["generation"] = time.perf_counter() - start
    start = time.perf_counter()
    adj = traverse.layout(graph.adjacency(raw))
    report.vertices, top = adj.edges.agg(F.countDistinct("src"), F.max("src")).first()
    report.max_vertex = top or 0
    report.seconds["construction"] = time.perf_counter() - start
    start = time.perf_counter()
    rows, columns = exchange.grid(settings.members)
    spread = exchange.redistribute(raw, rows, columns).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    raw.unpersist()
    report.seconds["redistribution"] = time.perf_counter() - start
    return spread, adj


def run(spark: SparkSession, settings: Settings) -> Report:
    """Ends at the first root with an invalid result; goes on where a log ends.

    A log of another scale, edge factor or number of workers raises
    :class:`~wavefront.sources.runlog.OtherBenchmark` and stays as it is.
    """
    report, spec = Report(settings), settings.spec
    same = {"scale": spec.scale, "edge_factor": spec.edge_factor, "workers": settings.members}
    if settings.log_folder and not runlog.read_header(spark, settings.log_folder).isEmpty():
        runlog.open_log(spark, settings.log_folder, **same)  # before any work
    raw, adj = prepare(spark, settings, report)
    first = 0
    if settings.log_folder:
        times = {f"{k}_time": v for k, v in report.seconds.items()}
        runlog.open_log(spark, settings.log_folder, **same, num_runs=settings.roots, **times)
        done = runlog.read_runs(spark, settings.log_folder)
        first = runlog.next_run(done).first()[0]
        report.runs = [tuple(r) for r in done.orderBy("run_id").collect()]  # one row for each root
    roots = kronecker_roots(adj.edges, spec, settings.roots)
    until = time.perf_counter() + settings.warm_up_s
    while time.perf_counter() < until:
        traverse.bfs(adj, roots[0], settings.direction, report.vertices)
    for i in range(first, len(roots)):
        start = time.perf_counter()
        search = traverse.bfs(adj, roots[i], settings.direction, report.vertices)
        reached = search.tree.count()
        bfs_time = time.perf_counter() - start
        start = time.perf_counter()
        if settings.validation == VALIDATE_ALL or settings.validation == VALIDATE_FIRST and i == 0:
            ok, traversed, failed = checks.validate(raw, search.tree, roots[i], report.max_vertex + 1)
        else:
            ok, traversed, failed = True, TRAVERSED.get(spec.scale, 0), []
        validate_time = time.perf_counter() - start
        log.info("root %d of %d: %d reached, %.3f s, %d edges", i + 1, len(roots), reached, bfs_time, traversed)
        report.levels = search.levels
        if not ok:
            report.failed = failed
            break
        report.runs.append((i, roots[i], bfs_time, validate_time, traversed))
        if settings.log_folder:
            runlog.append_run(spark, settings.log_folder, *report.runs[-1])
    raw.unpersist()
    adj.unpersist()
    return report


def report_df(runs: DataFrame) -> DataFrame:
    """(metric, value): statistics of times, edges, rates and validation times."""
    out = None
    for name, column in (("time", "bfs_time"), ("nedge", "edge_count"), ("validate", "validate_time")):
        part = stats.seven_numbers(runs, column).select(F.concat(F.col("metric"), F.lit(f"_{name}")).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(stats.teps_report(runs).select(F.concat(F.col("metric"), F.lit("_TEPS")).alias("metric"), "value"))


def settings_df(spark: SparkSession, settings: Settings) -> DataFrame:
    spec = settings.spec
    full = settings.roots == ROOTS and settings.validation == VALIDATE_ALL
    rows = [
        ("scale", str(spec.scale)), ("edge_factor", str(spec.edge_factor)), ("roots", str(settings.roots)), ("direction", settings.direction), ("validation", str(settings.validation)),
        ("alpha", str(traverse.ALPHA)), ("beta", str(traverse.BETA)), ("seeds", f"{spec.seed1}, {spec.seed2}"), ("benchmark_mode", "OK" if full else "no"),
    ]
    return spark.createDataFrame(rows, "setting string, value string")


def print_report(spark: SparkSession, report: Report) -> None:
    spec = report.settings.spec
    print(f"SCALE: {spec.scale}\nedgefactor: {spec.edge_factor}\nNBFS: {len(report.runs)}")
    for name, seconds in report.seconds.items():
        print(f"{name}_time: {seconds:.6g}")
    if not report.valid or not report.runs:
        print(f"No results printed for invalid run. Failed: {', '.join(report.failed) or 'no root was run'}")
        return
    for r in report_df(report.runs_df(spark)).collect():  # a few rows
        print(f"{r['metric']}: {'n/a' if r['value'] is None else format(r['value'], '.6g')}")
