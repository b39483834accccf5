import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costloom.operators import forecast as fc, optimize, reports, scope, series, smoothing

START = dt.datetime(2024, 1, 1, 12)


def noisy(n, base=10.0, noise=0.15, drift=0.0, gaps=(), seed=42):
    rng = random.Random(seed)
    return [0.0 if i in gaps else base * (1 + rng.uniform(-noise, noise)) * (1 + drift * i) for i in range(n)]


@pytest.fixture(scope="module")
def run(spark):
    """{id: (daily costs, baseline per day, days)} -> {id: record}; costs may be (time, cost) pairs."""

    def make(cases, history=()):
        usage, projects = [], []
        for i, (costs, base, days) in cases.items():
            for k, c in enumerate(costs):
                at, cost = c if isinstance(c, tuple) else (START + dt.timedelta(days=k), c)
                usage.append((i, at, "gpt-4o", 10, 5, float(cost)))
            projects.append((i, f"p{i}", float(base), days, float(base * days)))
        u = spark.createDataFrame(usage, "project_id long, timestamp timestamp, model string, tokens_in long, tokens_out long, cost_usd double")
        p = spark.createDataFrame(projects, "project_id long, name string, baseline_daily_cost double, baseline_total_days int, baseline_total_cost double")
        h = spark.createDataFrame(list(history), "project_id long, iteration int, projected_total double")
        return u, p, h, {r.project_id: r for r in fc.forecast(u, p, h).collect()}

    return make


def test_series(run):
    minutes = lambda step, n, cost: [(START + dt.timedelta(minutes=step * i), cost) for i in range(n)]
    cases = {
        1: ([10.0] * 14, 10, 14), 2: ([10.0] * 9 + [20.0] * 5, 10, 14), 3: ([], 5, 14), 4: ([1.0] * 2, 5, 14), 5: ([1.0] * 5, 5, 14), 6: ([1.0] * 10, 5, 14),
        7: (noisy(5), 10, 14), 8: (noisy(14), 10, 21), 9: (minutes(15, 8, 1.5), 10, 14), 10: (minutes(1, 12, 1.0), 10, 14), 11: ([10.0] * 7 + [2.0] * 7, 10, 14),
        12: ([10.0] * 7 + [50.0] + [10.0] * 6, 10, 14), 13: (noisy(14, gaps=(5, 6, 12, 13)), 10, 14), 14: (noisy(14, noise=0.1), 10, 21), 15: ([3.0] * 9 + [1.0] * 5, 10, 20),
    }
    *_, r = run(cases, [(1, k, 140.0) for k in range(1, 5)])
    assert r[1].actual_spend == 140 and r[1].active_days == 14 and abs(r[1].projected_total - 140) <= 28
    assert r[2].drift_status == "over_budget" and r[15].drift_status == "under_budget" and r[1].drift_status == "on_track"
    assert [r[i].confidence for i in (3, 4, 5, 6)] == ["low", "medium-low", "medium", "high"]
    assert r[3].models_used == ["ema_fallback"] and r[3].projected_remaining == pytest.approx(70) and r[3].mase is None
    assert "damped_trend" not in r[7].models_used and 1 <= r[7].n_models_used <= 2
    assert r[8].models_used == ["ses", "damped_trend", "linear"] and r[8].mase < 1
    i80, i95 = r[8].prediction_interval_80, r[8].prediction_interval_95
    assert i95.upper - i95.lower > i80.upper - i80.lower and i80.lower >= r[8].actual_spend and i95.lower >= 0
    assert r[9].data_granularity == "15min_buckets" and r[9].active_days == 1
    assert r[10].data_granularity == "5min_buckets" and "ema_fallback" not in r[10].models_used
    assert r[11].projected_total < 140 and r[12].projected_total < 200 and r[13].projected_total > 0 and r[14].mase < 1
    assert r[1].iteration == 5 and r[1].stability_label is not None and r[2].iteration == 1 and r[2].stability is None
    assert r[1].model_breakdown[0].share == pytest.approx(1) and r[3].model_breakdown == []


def test_error_shrinks(run):
    truth = noisy(14)
    u, p, *_ = run({1: (truth, 10, 14)})
    got = {r.cut: r.error for r in fc.backtest(u, p, [5, 14]).collect()}
    # after all days one more is still forecast, as in a project that has used up its days
    assert got[14] <= 1.15 * got[5] + 12


def test_smoothing_against_direct_search(spark):
    y = noisy(25, drift=0.02, seed=3)
    df = spark.createDataFrame([(1, y, len(y))], "project_id long, series array<double>, n int")
    r = smoothing.ses_optimal(df).first()

    def sse(alpha, level):
        total = 0.0
        for c in y:
            total += (c - level) ** 2
            level += alpha * (c - level)
        return total, level

    assert r.sse == pytest.approx(sse(r.alpha, r.level0)[0]) and r.level == pytest.approx(sse(r.alpha, r.level0)[1])
    assert all(r.sse <= sse(a / 100, level)[0] + 1e-9 for a in range(1, 100) for level in (y[0], np.mean(y), r.level0))
    t = smoothing.damped_trend(df).first()

    def damped(alpha, beta, phi, level, trend):
        total = 0.0
        for c in y:
            e = c - level - phi * trend
            total += e * e
            level, trend = level + phi * trend + alpha * e, phi * trend + beta * e
        return total

    starts = [(y[0], y[1] - y[0]), (np.mean(y), 0.0), (y[0], 0.0)]
    assert all(t.sse <= damped(a, a * share, phi, *s) + 1e-6 for a, share, phi in smoothing.trend_grid() for s in starts)
    line = smoothing.linear(df).first()
    assert (line.slope, line.intercept) == pytest.approx(tuple(np.polyfit(range(25), y, 1)))
    ratio = 1.0
    for c in y:
        ratio = 0.6 * c / 10 + 0.4 * ratio
    assert df.select(smoothing.ema_state(F.col("series"), F.lit(10.0))).first()[0] == pytest.approx(ratio)


def test_plans(run):
    u, p, *_ = run({1: (noisy(12), 10, 14)})
    plan = fc.core(u, p)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert smoothing.ses(series.series_choice(u, p))._jdf.queryExecution().toString().count("FlatMapGroupsInPandas") == 0


def test_reports(run, spark, tmp_path):
    u, p, h, r = run({1: ([1.0] * 5, 1, 10), 2: ([1.0] * 5, 1, 10), 3: ([0.0] * 3, 1, 10), 4: ([25.0] * 2, 1, 10)})
    rec = fc.forecast(u, p, h)
    budgets = spark.createDataFrame([(1, 1000.0), (2, 6.0), (4, 1.0), (3, None)], "project_id long, budget double")
    assert {x.project_id: x.code for x in reports.budget_status(rec, budgets).collect()} == {1: 0, 2: 1, 3: 0, 4: 2}
    s = {x.project_id: x for x in reports.status(rec).collect()}
    assert s[3].subscription and not s[1].subscription and s[1].confidence_level == 3 and "tokens" not in reports.status(rec, brief=True).columns
    long = {(x.project_id, x.metric): x.value for x in reports.forecast_long(rec).collect()}
    assert long[1, "actual_spend"] == 5 and (1, "model:gpt-4o") in long
    assert '"mase":null' in reports.as_json(rec).filter("project_id = 3").first().document
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "project_id long")
    assert [x.project_id for x in fc.for_projects(u, p, h, ids(2, 2)).collect()] == [2]
    with pytest.raises(Exception, match="project 99999 not found"):
        many = spark.range(1, 5).union(spark.range(99999, 100000)).toDF("project_id")
        fc.as_history(fc.for_projects(u, p, h, many)).write.parquet(str(tmp_path / "no"))
    assert not list((tmp_path / "no").glob("part*"))


def test_a_saved_run_is_computed_once(run, spark, tmp_path):
    u, p, h, _ = run({1: ([1.0] * 5, 1, 10), 2: (noisy(12), 10, 14)})
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = u.count()
    watched = u.mapInArrow(count, u.schema)
    fc.forecast(watched, p, h).collect()
    once = seen.value
    record = fc.run(watched, p, h, str(tmp_path / "h"))
    got = {r.project_id: r for r in record.collect()}
    assert seen.value == 2 * once and once >= rows
    stored = {r.project_id: r for r in spark.read.parquet(str(tmp_path / "h")).collect()}
    assert {(i, r.iteration, r.projected_total) for i, r in stored.items()} == {(i, r.iteration, r.projected_total) for i, r in got.items()}
    fc.run(u, p, spark.read.parquet(str(tmp_path / "h")), str(tmp_path / "h"))
    assert sorted(r.iteration for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [1, 1, 2, 2]


def test_suggestions(spark):
    def calls(model, n, i, o, cost):
        return [(1, model, i, o, cost / n)] * n

    rows = calls("gpt-4", 4, 100, 100, 10.0) + calls("gpt-4o", 4, 100, 100, 8.0) + calls("claude-3-opus-20240229", 2, 1, 900, 1.0)
    rows += calls("o1", 2, 30000, 900, 6.0) + calls("grok-3", 2, 10, 10, 5.0) + calls("llama-3.1-405b", 2, 30000, 900, 3.0) + calls("mistral-large-latest", 2, 10, 10, 4.0) + calls("gemini-pro", 3, 10, 10, 1.0)
    rows += [(2, "gpt-4o", 6000, 100, 3.0), (2, "gpt-4o", 6000, 700, 5.0), (3, "claude-3-5-sonnet-latest", 9000, 700, 5.0)]
    u = spark.createDataFrame(rows, "project_id long, model string, tokens_in long, tokens_out long, cost_usd double")
    got = {(r.project_id, r.model): r for r in optimize.suggestions(u).collect()}
    assert got[1, "gpt-4"].alternative == "gpt-4o" and got[1, "gpt-4"].savings == pytest.approx(9.2)
    assert got[1, "gpt-4o"].alternative == "gpt-4o-mini" and got[1, "gpt-4o"].savings == pytest.approx(8 * 0.94)
    assert got[1, "claude-3-opus-20240229"].task == "Heavy" and got[1, "claude-3-opus-20240229"].savings == pytest.approx(0.8)
    assert got[1, "o1"].alternative == "deepseek-reasoner" and got[1, "o1"].reason == "Lateral Tier 1 move (2 heavy calls)"
    assert got[1, "grok-3"].alternative == "grok-2" and got[1, "mistral-large-latest"].alternative == "mistral-medium-latest" and got[1, "mistral-large-latest"].savings == 0
    assert got[1, "llama-3.1-405b"].alternative == "deepseek-reasoner" and (1, "gemini-pro") not in got
    assert got[2, "gpt-4o"].savings == pytest.approx(3 * 0.94) and got[2, "gpt-4o"].reason == "1/2 calls have short outputs"
    assert (3, "claude-3-5-sonnet-latest") not in got
    assert {r.project_id: r.suggestions for r in optimize.total_savings(optimize.suggestions(u)).collect()} == {1: 7, 2: 1}


def test_scope(spark):
    rows = [(1, "main.py", "import openai\n"), (1, "README.md", "RAG system for retrieval"), (2, "main.py", "import openai"), (2, "README.md", "chatbot"), (3, "x.txt", "")]
    rows += [(4, f"src/f{i}.py", "from anthropic import x" if i == 3 else "") for i in range(12)] + [(4, "package.json", ""), (4, "node_modules/a.js", ""), (4, ".git/x", ""), (4, "a/b/c/d/e/f/g.py", ""), (4, "Makefile", "")]
    df = spark.createDataFrame(rows, "project_id long, path string, content string")
    got = {r.project_id: r for r in scope.baseline(df).collect()}
    assert (got[1].project_type, got[1].daily_cost, got[1].total_cost) == ("rag", pytest.approx(0.4405), pytest.approx(3.0835))
    assert (got[2].project_type, got[2].daily_cost, got[2].estimated_days) == ("agent", pytest.approx(1.6), 7)
    assert (got[3].project_type, got[3].daily_cost, got[3].model) == ("default", pytest.approx(0.0345), "gpt-4o-mini")
    assert got[4].model == "claude-3-5-haiku-latest" and got[4].estimated_days == 14
    counts = {r.ext: r.files for r in scope.extension_counts(df).filter("project_id = 4").collect()}
    assert counts == {".py": 12, ".json": 1, "package.json": 1, "(no ext)": 1}
    p = {r.id: r for r in scope.as_projects(scope.baseline(df), days=10, budget=5.0).collect()}
    assert p[2].baseline_total_cost == pytest.approx(16) and '"budget":5.0' in p[2].metadata
    assert {r.id: r.against_budget for r in scope.baseline_budget(scope.as_projects(scope.baseline(df)), 5.0).collect()}[2] == "over"
