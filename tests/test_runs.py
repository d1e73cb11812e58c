"""Statistics, run log, codes, benchmark, catalogue."""

import math

import duckdb
import pytest
from wavefront.functions import codec
from wavefront.operators import exchange, stats
from wavefront.plans import benchmark, catalog, cli
from wavefront.sources import runlog
from wavefront.sources.kronecker import EdgeSpec
from wavefront.streaming import ingest_edges


def test_seven_numbers(spark):
    got = dict(map(tuple, stats.seven_numbers(spark.createDataFrame([(float(i),) for i in range(1, 17)], "x double"), "x").collect()))
    assert [got[m] for m in stats.SEVEN[:6]] == [1, 4.5, 8.5, 12.5, 16, 8.5]
    assert math.isclose(got["std"], math.sqrt(340 / 15))


def test_teps(spark):
    runs = spark.createDataFrame([(1.0, 100), (2.0, 100), (4.0, 100)], "bfs_time double, edge_count long")
    got = dict(map(tuple, stats.teps_report(runs).collect()))
    assert (got["min"], got["max"]) == (25, 100) and math.isclose(got["harmonic_mean"], 300 / 7)


def test_run_log(spark, tmp_path):
    folder = str(tmp_path)
    assert runlog.next_run(runlog.read_runs(spark, folder)).first()[0] == 0
    runlog.write_header(spark, folder, scale=5, edge_factor=16)
    for i in range(3):
        runlog.append_run(spark, folder, i, i, 1.5, 0.5, 10)
    runs, header = runlog.read_runs(spark, folder), runlog.read_header(spark, folder)
    assert runlog.next_run(runs, header, scale=5).first()[0] == 3
    assert runlog.next_run(runs, header, scale=6).first()[0] == 0


@pytest.mark.parametrize("order", "<>")
def test_binary_log(spark, tmp_path, order):
    header, runs = (16, 16, 4, 2, 1.0, 2.0, 3.0), [(0.5, 0.25, 100), (0.75, 0.25, 200)]
    (tmp_path / "log.bin").write_bytes(runlog.write_binary(header, runs, order))
    rows = runlog.read_binary(spark, str(tmp_path / "log.bin")).orderBy("run_id").collect()
    assert [(r["scale"], r["run_id"], r["bfs_time"], r["edge_count"]) for r in rows] == [(16, 0, 0.5, 100), (16, 1, 0.75, 200)]


def test_codes():
    values = [0, 1, 127, 128, 300, (1 << 62) + 5, -1]
    assert codec.decode_varint(codec.encode_varint(values)) == values
    assert codec.encode_varint([300]) == b"\xac\x02"
    assert [codec.partition_bounds(10, 4, p) for p in range(4)] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    keys = [0, 1, 2, 3, 16, 17, 32, 33]
    cuts = [codec.aligned_bounds(keys, 4, 3, p) for p in range(3)]
    assert cuts[0][0] == 0 and cuts[-1][1] == 8 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert exchange.grid(12) == (3, 4) and exchange.grid(7) == (1, 7)
    assert codec.swap_endian(b"\1\0\0\0", "i") == b"\0\0\0\1"


def test_benchmark_and_resume(spark, tmp_path):
    settings = benchmark.Settings(EdgeSpec(6), roots=2, log_folder=str(tmp_path / "log"), spill_folder=str(tmp_path / "spill"))
    report = benchmark.run(spark, settings)
    assert report.valid and [r[4] for r in report.runs] == [1024, 1024]
    more = benchmark.Settings(EdgeSpec(6), roots=3, log_folder=str(tmp_path / "log"))
    again = benchmark.run(spark, more)
    assert [r[0] for r in again.runs] == [0, 1, 2] and again.runs[:2] == report.runs
    benchmark.print_report(spark, again)
    metrics = {r["metric"] for r in benchmark.report_df(again.runs_df(spark)).collect()}
    assert {"median_time", "mean_nedge", "harmonic_mean_TEPS", "std_validate"} <= metrics


def test_logs_of_other_benchmarks(spark, tmp_path):
    """Scale 5, then 6 into the same folder, is refused and changes nothing; scale 5 goes on with all its own roots."""
    folder = str(tmp_path / "log")
    first = benchmark.run(spark, benchmark.Settings(EdgeSpec(5), roots=2, log_folder=folder))
    for other in (benchmark.Settings(EdgeSpec(6), roots=2, log_folder=folder), benchmark.Settings(EdgeSpec(5, 8), roots=2, log_folder=folder), benchmark.Settings(EdgeSpec(5), roots=2, members=6, log_folder=folder)):
        with pytest.raises(runlog.OtherBenchmark):
            benchmark.run(spark, other)
    again = benchmark.run(spark, benchmark.Settings(EdgeSpec(5), roots=4, log_folder=folder))
    assert [r[0] for r in again.runs] == [0, 1, 2, 3] and again.runs[:2] == first.runs
    assert {r["edge_count"] for r in runlog.read_runs(spark, folder).collect()} == {512} and runlog.read_header(spark, folder).count() == 1
    runlog.append_run(spark, str(tmp_path / "bare"), 0, 1, 1.0, 1.0, 5)
    with pytest.raises(runlog.OtherBenchmark):
        benchmark.run(spark, benchmark.Settings(EdgeSpec(5), roots=1, log_folder=str(tmp_path / "bare")))


def test_blocked_bounds():
    assert [codec.blocked_bounds([0, 10, 14], 3, p) for p in range(6)] == [(0, 4), (4, 8), (8, 10), (10, 12), (12, 14), (14, 14)]


def test_varint_columns(spark):
    lists = [[], [0, 1, 127, 128], None, [-1, 1 << 62], [300] * 5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<long>").coalesce(1)
    rows = df.select("i", codec.varint_bytes("x").alias("b")).select("i", "b", codec.varint_values("b").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == lists and bytes(rows[4]["b"]) == b"\xac\x02" * 5


def test_command_line(spark, capsys):
    assert cli.main(["--scale", "5", "--print-plan"]) == 0
    assert "edge_factor" in capsys.readouterr().out


def test_stream_of_edges(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2), (2, 2)], "v0 long, v1 long").write.parquet(source)
    for _ in range(2):
        ingest_edges(spark, source, sink, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(sink).count() == 2


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


SLOW = {"bfs_deep"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_against_sql(spark, duck, data, name):
    got = catalog.queries()[name](spark, data)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(r[n] for n in names) for r in got.select(*[f"`{n}`" for n in names]).collect())
    expected = sorted(want.fetchall())
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected):
        assert all(math.isclose(x, y, rel_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def test_queries_without_sql(spark, data):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, data).count() > 0


def test_separated_ids_beyond_the_packing(spark, tmp_path):
    """Parts whose ids take more than the 20 bits of the query, and more than 31."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS o_orderkey, i * 7919 AS o_custkey FROM range(1, 9) t(i)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (SELECT i AS l_orderkey, CAST(p AS BIGINT) AS l_partkey FROM range(1, 9) t(i), unnest([3, 524287, 524288, 1200000, 1500000000]) u(p)) TO '{tmp_path}/lineitem.parquet'")
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    got = sorted(map(tuple, catalog.queries()["separated_id"](spark, str(tmp_path)).collect()))
    assert len(got) == 40 and got == sorted(con.execute(catalog.oracle_sql()["separated_id"]).fetchall())
