"""Stored tables and streams: pruned reads, purges that touch what they must, counters, versions."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from costloom.operators import aggregates as agg
from costloom.sources import ingest, schemas, tables
from costloom.streaming import live

T = dt.datetime.fromisoformat


def rows_of(spark, rows):
    return spark.createDataFrame([(i, p, at, "gpt-4o", "openai", 10, 5, cost, None, "api") for i, (p, at, cost) in enumerate(rows)], schemas.USAGE)


@pytest.fixture
def by_day(spark, tmp_path):
    """Project 1 on three days, project 2 on two of these and one of its own; and a row without a time."""
    path = str(tmp_path / "usage")
    days = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 1)]
    rows = rows_of(spark, [(p, T(f"2024-01-0{d}T23:59:59.5"), p + d / 10) for p, d in days] + [(1, None, 9.0), (2, None, 8.0)])
    tables.append_usage(rows.coalesce(1), path)
    return path, rows


def files(path):
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.read_bytes()) for f in path.rglob("*.parquet")}


def test_a_period_reads_its_days(by_day, spark):
    path, rows = by_day
    late = rows_of(spark, [(4, T("2024-01-02T00:00:00"), 1.0), (4, T("2024-01-03T00:00:00"), 1.0)])
    tables.append_usage(late, path)
    found = tables.read_usage(spark, path, T("2024-01-02T00:00:00"), T("2024-01-03T00:00:00"))
    assert sorted((r.project_id, r.timestamp.day) for r in found.collect()) == [(1, 2), (2, 2), (4, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "2024-01-01" in pruned and "2024-01-04" in pruned and "PushedFilters: [" in plan
    assert tables.read_usage(spark, path).count() == 11 and found.columns == schemas.USAGE.names
    assert tables.read_usage(spark, path, until=T("2024-01-02T00:00:00")).count() == 2
    flat = path + "-flat"
    rows.write.parquet(flat)
    assert tables.read_usage(spark, flat, T("2024-01-03T00:00:00")).count() == 3


def test_purge_touches_only_folders_that_hold_the_project(by_day, spark, tmp_path):
    path, _ = by_day
    before = files(tmp_path / "usage")
    gone = spark.createDataFrame([(2,), (2,), (77,)], "project_id long")
    assert tables.purge_stored(spark, path, gone) == (3, 1)  # two days and the rows without one; a day that had nothing else
    after = files(tmp_path / "usage")
    untouched = {n: f for n, f in before.items() if n.startswith("day=2024-01-01")}
    assert untouched and untouched.items() <= after.items()
    assert not any(n.startswith("day=2024-01-04") for n in after) and not set(before) & set(after) - set(untouched)
    assert sorted((r.project_id, r.cost_usd) for r in tables.read_usage(spark, path).collect()) == [(1, 1.1), (1, 1.2), (1, 1.3), (1, 9.0), (3, 3.1)]
    assert tables.purge_stored(spark, path, gone) == (0, 0) and files(tmp_path / "usage") == after


def test_reset_of_stored_tables(by_day, spark, tmp_path):
    path, rows = by_day
    runs, projects = str(tmp_path / "runs"), str(tmp_path / "projects")
    spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0)], "project_id long, iteration int, projected_total double").write.parquet(runs)
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.parquet(projects)
    before = files(tmp_path / "usage")
    gone = spark.createDataFrame([(2,)], "project_id long")
    tables.reset_stored(spark, path, runs, projects, gone, keep_usage=True)
    assert files(tmp_path / "usage") == before
    assert [r.project_id for r in spark.read.parquet(runs).collect()] == [1] and [r.id for r in spark.read.parquet(projects).collect()] == [1]
    tables.reset_stored(spark, path, runs, projects, gone)
    assert tables.read_usage(spark, path).filter("project_id = 2").count() == 0
    with pytest.raises(ValueError, match="no partitions"):
        tables.purge_stored(spark, runs, gone)


@pytest.fixture
def raw(spark):
    good = '{"model":"gpt-4o","usage":{"prompt_tokens":5,"completion_tokens":6}}'
    bodies = [good] * 4 + ["", '{"usage":{"prompt_tokens":"x","completion_tokens":1}}', "[1]"]
    rows = [(i % 3, T("2024-01-01T23:59:00") + dt.timedelta(minutes=i), "application/json", b) for i, b in enumerate(bodies)] + [(1, T("2024-01-01T10:00:00"), "text/event-stream", good)]
    return spark.createDataFrame(rows, schemas.RAW)


COUNTS = {"tracked": 4, "skipped_streaming": 1, "ignored": 1, "error": 2}


def test_counters_come_with_the_append(raw, spark, tmp_path):
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    assert ingest.append_ingested(raw.mapInArrow(count, raw.schema), str(tmp_path / "u")) == COUNTS
    assert parsed.value == 8 and tables.read_usage(spark, str(tmp_path / "u")).count() == 4
    by_project = ingest.ingest_stats(raw).agg(*[F.sum(s).alias(s) for s in COUNTS]).first().asDict()
    assert by_project == COUNTS


def until(test):
    end = time.time() + 20
    while not test() and time.time() < end:
        time.sleep(0.2)
    return test()


def test_streams_count_and_write_days(raw, spark, tmp_path):
    source, out = str(tmp_path / "raw"), str(tmp_path / "out")
    raw.repartition(2).write.parquet(source)
    counters = live.Counters()
    spark.streams.addListener(counters)
    try:
        stream = lambda: live.raw_stream(spark, source, "parquet", maxFilesPerTrigger=1)
        live.start_ingest(stream(), out, str(tmp_path / "ck"), once=True).awaitTermination()
        assert until(lambda: counters.responses == COUNTS)
        live.start_ingest(stream(), out, str(tmp_path / "ck"), once=True).awaitTermination()  # nothing new
        found = tables.read_usage(spark, out, T("2024-01-02T00:00:00"))
        assert found.count() == 3 and tables.read_usage(spark, out).count() == 4
        assert tables.partition_columns(spark, out) == ["day", "batch"]
        assert tables.purge_stored(spark, out, spark.createDataFrame([(0,)], "project_id long")) != (0, 0)
        assert tables.read_usage(spark, out).count() == 2
    finally:
        spark.streams.removeListener(counters)


def test_totals_survive_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 3)
    source, out, state = (str(tmp_path / n) for n in ("usage", "totals", "state"))
    assert live.read_totals(spark, out).collect() == []
    for k in range(8):
        rows_of(spark, [(p, T("2024-01-01T10:00:00"), float(k)) for p in (k % 3, 7)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.USAGE).parquet(source)
        live.start_totals(stream, out, state, once=True).awaitTermination()
        want = sorted(map(tuple, agg.project_totals(spark.read.parquet(source)).collect()))
        assert sorted(map(tuple, live.read_totals(spark, out).collect())) == want
    kinds = [f[:2] for f in live._folders(spark, out)]
    assert kinds == [("delta", 7), ("full", 6)] or kinds == [("delta", 7), ("full", 6), ("full", 3), ("delta", 5), ("delta", 4)]
    assert spark.read.parquet(f"{out}/delta=7").count() == 2  # the projects that changed
    # the last batch once more, as after a failure
    for name in ("7", ".7.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    live.start_totals(spark.readStream.schema(schemas.USAGE).parquet(source), out, state, once=True).awaitTermination()
    assert sorted(map(tuple, live.read_totals(spark, out).collect())) == want


def test_all_sizes_from_one_stream(spark, tmp_path):
    source, out = str(tmp_path / "usage"), str(tmp_path / "out")
    minutes = [0, 0.5, 1, 4, 6, 14, 15, 17, 29, 31, 44, 46, 80, 200]
    on_time = rows_of(spark, [(i % 2, T("2024-01-01T23:20:00") + dt.timedelta(minutes=m), 1.0 + i) for i, m in enumerate(minutes)])
    on_time.coalesce(1).write.parquet(source)
    counters = live.Counters()
    spark.streams.addListener(counters)
    try:
        def go():
            rows = live.live_sizes(spark.readStream.schema(schemas.USAGE).parquet(source))
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

        go()
        closed = {k: {(r.project_id, r.bucket, r.cost, r.total_tokens) for r in spark.read.parquet(out).filter(F.col("minutes") == k).collect()} for k in (15, 5, 1)}
        for k in (15, 5, 1):
            assert closed[k] == {tuple(r) for r in agg.bucketed_costs(on_time, k).filter("bucket < '2024-01-02 02:30'").collect()}
        late = rows_of(spark, [(0, T("2024-01-01T23:20:00"), 5.0), (1, T("2024-01-02T09:00:00"), 5.0)])
        late.coalesce(1).write.mode("append").parquet(source)
        go()
        assert until(lambda: counters.late == 1)
        again = spark.read.parquet(out).filter("bucket like '2024-01-01 23:2%' and minutes = 1").collect()
        assert {(r.project_id, r.bucket, r.cost, r.total_tokens) for r in again} <= closed[1] and {r.cost for r in again if r.bucket.endswith("23:20")} == {1.0, 2.0}
    finally:
        spark.streams.removeListener(counters)
