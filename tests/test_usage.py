import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from costloom.operators import aggregates as agg
from costloom.sources import ingest, schemas, tables
from costloom.streaming import live

T = lambda s: dt.datetime.fromisoformat(s)


@pytest.fixture
def usage(spark):
    rows = [(1, 1, T("2024-01-01T12:00:00"), "gpt-4o", "openai", 1000, 500, 5.0, None, None), (2, 1, T("2024-01-01T12:00:00"), "gpt-4o", "openai", 500, 200, 2.0, None, "cursor"), (3, 1, T("2024-01-02T12:00:00"), "gpt-4o-mini", "openai", 100, 50, 0.5, None, None)]
    return spark.createDataFrame(rows, schemas.USAGE)


def test_daily_and_totals(usage):
    rows = sorted(map(tuple, agg.daily_costs(usage).collect()))
    assert [r[2:] for r in rows] == [(7.0, 2200), (0.5, 150)]
    assert agg.active_days(usage).first().active_days == 2
    t = agg.project_totals(usage).first()
    assert (t.calls, t.total_tokens, t.spend) == (3, 2350, 7.5)
    s = {r.model: (r.calls, r.tokens) for r in agg.session_summary(usage).collect()}
    assert s == {None: (3, 2350), "gpt-4o": (2, 2200), "gpt-4o-mini": (1, 150)}


def test_buckets(spark):
    start = T("2026-03-10T14:00:00")
    rows = [(i, 1, start + dt.timedelta(minutes=m), "gpt-4o", "openai", 1, 1, 1.0, None, "api") for i, m in enumerate((0, 5, 10, 20, 35, 50, 65, 80))]
    df = spark.createDataFrame(rows, schemas.USAGE)
    got = {r.bucket[-5:]: r.cost for r in agg.bucketed_costs(df, 15).collect()}
    assert got == {"14:00": 3, "14:15": 1, "14:30": 1, "14:45": 1, "15:00": 1, "15:15": 1}
    assert {r.bucket[-5:] for r in agg.bucketed_costs(df, 25).collect()} == {"14:00", "14:25", "14:50", "15:00"}
    with pytest.raises(ValueError):
        agg.bucketed_costs(df, 0)


def test_storage(usage, spark, tmp_path):
    path = str(tmp_path / "usage")
    tables.append_usage(usage, path)
    back = tables.read_usage(spark, path)
    assert {r.id: r.source for r in back.collect()} == {1: "api", 2: "cursor", 3: "api"}
    old = str(tmp_path / "old")
    usage.drop("source").write.parquet(old)
    assert {r.source for r in tables.read_usage(spark, old).collect()} == {"api"}
    tables.write_csv(tables.export_usage(usage, 2).drop("project_id").coalesce(1), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part*")).read_text().splitlines()
    assert lines[0] == ",".join(schemas.EXPORT_COLUMNS) and len(lines) == 3
    tables.write_json(usage.select(*schemas.JSON_COLUMNS), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_projects(spark, tmp_path):
    make = lambda rows: spark.createDataFrame([(i, f"p{i}", path, 1.0, 7, 7.0, meta, T("2024-01-01T00:00:00")) for i, path, meta in rows], schemas.PROJECTS)
    have = make([(1, "/a", json.dumps({"budget": 5.0, "model": "gpt-4o"})), (2, "/b", ""), (3, "/c", None)])
    got = {r.path: r.metadata for r in tables.project_lookup(have, ["/a", "/b", "/zz"]).collect()}
    assert got["/a"].budget == 5.0 and got["/b"] is None and len(got) == 2
    assert tables.add_projects(make([(4, "/d", None)]), have).count() == 1
    for k, bad in enumerate(([(4, "/a", None), (6, "/e", None)], [(4, "/d", None), (5, "/d", None)])):
        with pytest.raises(Exception, match="exists already"):
            tables.add_projects(make(bad), have).write.parquet(f"{tmp_path}/{k}")
        assert not list((tmp_path / str(k)).glob("part*"))
    runs = spark.createDataFrame([(1, 1), (2, 1)], "project_id long, iteration int")
    gone = spark.createDataFrame([(1,)], "project_id long")
    usage, left_runs, left = tables.reset(runs, runs, have, gone)
    assert usage.count() == 1 and left_runs.count() == 1 and {r.id for r in left.collect()} == {2, 3}
    assert tables.reset(runs, runs, have, gone, keep_usage=True)[0].count() == 2


BODIES = [
    ({"model": "gpt-4o-2024-08-06", "usage": {"prompt_tokens": 50, "completion_tokens": 25}}, "tracked", (50, 25)),
    ({"model": "claude-3-5-sonnet-20241022", "usage": {"input_tokens": 100, "output_tokens": 50}}, "tracked", (100, 50)),
    ({"model": "text-embedding-3-small", "usage": {"prompt_tokens": 200, "completion_tokens": 0}}, "tracked", (200, 0)),
    ({"error": {"code": 1}}, "ignored", None),
    ({"results": [1, 2, 3]}, "ignored", None),
    ({"usage": "none"}, "ignored", None),
    ({"usage": {"prompt_tokens": "x", "completion_tokens": 1}}, "error", None),
    ({"model": 5, "id": "run-1", "usage": {"prompt_tokens": 1.9, "completion_tokens": "7"}}, "tracked", (1, 7)),
    ([1], "error", None),
    ("", "ignored", None),
    ("{not json", "ignored", None),
    (None, "ignored", None),
]


@pytest.fixture
def raw(spark):
    text = lambda b: b if b is None or isinstance(b, str) else json.dumps(b)
    rows = [(i, T("2024-01-01T10:00:00"), "application/json", text(b)) for i, (b, *_) in enumerate(BODIES)]
    rows += [(50, T("2024-01-01T10:00:00"), "text/event-stream", text(BODIES[0][0])), (None, T("2024-01-01T10:00:00"), None, text(BODIES[0][0]))]
    return spark.createDataFrame(rows, schemas.RAW)


def test_ingest(raw):
    got = {r.project_id: r for r in ingest.classify(raw).collect()}
    for i, (_, status, tokens) in enumerate(BODIES):
        assert got[i].status == status, i
        if tokens:
            assert (got[i].tokens_in, got[i].tokens_out) == tokens
    assert got[50].status == "skipped_streaming" and got[None].status == "ignored"
    assert ingest.classify(raw, skip_streaming=False).filter("project_id = 50 and status = 'tracked'").count() == 1
    rows = {r.project_id: r for r in ingest.ingest(raw).collect()}
    assert rows[2].cost_usd > 0 and rows[1].provider == "anthropic" and rows[0].source == "api" and rows[7].model == "run-1"
    stats = ingest.ingest_stats(raw).agg(F.sum("tracked"), F.sum("skipped_streaming"), F.sum("error")).first()
    assert tuple(stats) == (4, 1, 2)


def test_lenient_and_manual(spark):
    body = json.dumps({"usage": {"prompt_tokens": 5, "output_tokens": 6}})
    raw = spark.createDataFrame([(1, T("2024-01-01T10:00:00"), "text/event-stream", body)], schemas.RAW)
    r = ingest.ingest_lenient(raw).first()
    assert (r.tokens_in, r.tokens_out, r.model) == (5, 6, "unknown")
    calls = spark.createDataFrame([(1, T("2024-01-01T10:00:00"), "gpt-4o", "wrong", 8, 500, {"k": "v"}), (2, T("2024-01-01T10:00:00"), "gpt-4o", "wrong", 8, 500, {})], "project_id long, timestamp timestamp, model string, provider string, tokens_in long, tokens_out long, metadata map<string,string>")
    rows = {r.project_id: r for r in ingest.manual_calls(calls).collect()}
    assert rows[1].provider == "openai" and rows[1].metadata == '{"k":"v"}' and rows[2].metadata is None and rows[1].cost_usd == pytest.approx(0.00502)


def test_streams_equal_batch(raw, spark, tmp_path):
    source = str(tmp_path / "raw")
    raw.write.parquet(source)
    seen = []

    def hook(batch, number):
        seen.append(batch.count())
        raise RuntimeError("hooks may fail")

    q = live.start_ingest(live.raw_stream(spark, source, "parquet"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    key = lambda df: sorted(map(str, df.select(*ingest.OUT).collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(ingest.ingest(raw))
    q = live.start_ingest(live.raw_stream(spark, source, "parquet"), str(tmp_path / "out2"), str(tmp_path / "ck2"), hook, once=True)
    q.awaitTermination()
    assert q.exception() is None and sum(seen) == 4
    assert key(spark.read.parquet(str(tmp_path / "out2"))) == key(ingest.ingest(raw))


def test_live_buckets_equal_batch(usage, spark, tmp_path):
    source, place = str(tmp_path / "usage"), str(tmp_path / "out")
    usage.write.parquet(source)
    rows = live.live_buckets(spark.readStream.schema(schemas.USAGE).parquet(source), 15)
    rows.writeStream.format("parquet").option("path", place).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    closed = set(map(tuple, spark.read.parquet(place).collect()))
    assert closed and closed <= set(map(tuple, agg.bucketed_costs(usage, 15).collect()))
