"""Whole runs: the benchmark, its report, the command line, the query catalogue."""
