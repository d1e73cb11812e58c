"""Command line: ``python -m wavefront.plans.cli --scale 12 --roots 4``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources import runlog
from ..sources.kronecker import EDGE_FACTOR, PROFILE_2010, PROFILE_2012, EdgeSpec
from .benchmark import ROOTS, TEST_ROOTS, Settings, print_report, report_df, run, settings_df


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Breadth-first search benchmark on generated graphs")
    p.add_argument("--scale", type=int, default=16)
    p.add_argument("--edgefactor", type=int, default=EDGE_FACTOR)
    p.add_argument("--profile", choices=["2010", "2012"], default="2010")
    p.add_argument("--roots", type=int, help=f"default {TEST_ROOTS}, or {ROOTS} with --full")
    p.add_argument("--full", action="store_true")
    p.add_argument("--direction", choices=["hybrid", "top_down", "bottom_up"], default="hybrid")
    p.add_argument("--validation-level", type=int, choices=[0, 1, 2], default=2)
    p.add_argument("--members", type=int, default=4, help="members of the edge grid")
    p.add_argument("--log", help="folder of a run log; an interrupted run goes on")
    p.add_argument("--spill", help="folder for the raw edges, instead of memory")
    p.add_argument("--increasing-scale", action="store_true", help="go on with the next scale until a run fails")
    p.add_argument("--read-log", help="report what a folder (or a binary log) holds, and end")
    p.add_argument("--print-plan", action="store_true", help="print the settings and end")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("wavefront").getOrCreate()
    if a.read_log:
        binary = a.read_log.endswith(".bin")
        runs = runlog.read_binary(spark, a.read_log) if binary else runlog.read_runs(spark, a.read_log)
        report_df(runs).show(100, False)
        return 0
    profile = PROFILE_2010 if a.profile == "2010" else PROFILE_2012
    scale = a.scale
    while True:
        roots = a.roots or (ROOTS if a.full else TEST_ROOTS)
        log = f"{a.log}/scale{scale}" if a.log and a.increasing_scale else a.log
        settings = Settings(EdgeSpec(scale, a.edgefactor, **profile), roots, a.direction, a.validation_level, a.members, log, a.spill)
        if a.print_plan:
            settings_df(spark, settings).show(100, False)
            return 0
        report = run(spark, settings)
        print_report(spark, report)
        if not report.valid or not a.increasing_scale:
            return int(not report.valid)
        scale += 1


if __name__ == "__main__":
    raise SystemExit(main())
