"""The searched fits against far finer searches, and the backtest against forecasts of cut series."""

import datetime as dt

import numpy as np
import pytest

from costloom.operators import forecast as fc, smoothing

START = dt.datetime(2020, 1, 1, 12)


def some_series(count, seed):
    rng = np.random.default_rng(seed)

    def one(i):
        n = int(rng.integers(10, 60))
        noise = 10 * (1 + rng.uniform(-0.3, 0.3, n))
        return [noise, np.maximum(0, 10 + np.cumsum(rng.normal(size=n))), noise * (1 + 0.03 * np.arange(n)), np.where(np.arange(n) % 7 > 4, 0, noise), rng.lognormal(1, 1, n)][i % 5]

    return sorted((one(i) for i in range(count)), key=lambda s: -len(s))


def test_damped_trend_against_a_grid_fifty_times_finer():
    y, live = smoothing._columns(some_series(100, 1))
    found = smoothing._fit_trend(y, live)[3]
    grid = np.array([(a, s, p) for a in np.linspace(0.0001, 0.9999, 48) for s in np.linspace(0, 1, 17) for p in np.linspace(0.8, 0.98, 18)])
    assert len(grid) >= 50 * len(smoothing.trend_grid())
    best = np.full(len(y), np.inf)
    for part in np.array_split(grid, 60):
        best = np.minimum(best, smoothing._trend_states(y, live, np.tile(part, (len(y), 1, 1)))[0][0].min(1))
    assert (found <= best * 1.001).all()


def test_fit_is_that_of_its_parameters():
    """The error, level and trend that come with a fit are those of a plain run, from the best start."""
    for y in some_series(10, 2):
        phi, level, trend, sse, alpha, beta = (x[0] for x in smoothing._fit_trend(*smoothing._columns([y])))
        rows = []
        for start in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0)):
            (lv, tr), errors = start, []
            for c in y:
                e = c - lv - phi * tr
                errors.append(e)
                lv, tr = lv + phi * tr + alpha * e, phi * tr + beta * e
            rows.append((np.array(errors), lv, tr))
        a = np.stack([rows[1][0] - rows[0][0], rows[2][0] - rows[0][0]], 1)
        (l0, b0), *_ = np.linalg.lstsq(a, -rows[0][0], rcond=None)
        assert sse == pytest.approx(((rows[0][0] + a @ (l0, b0)) ** 2).sum(), rel=1e-6, abs=1e-6)
        assert level == pytest.approx(rows[0][1] + l0 * (rows[1][1] - rows[0][1]) + b0 * (rows[2][1] - rows[0][1]), rel=1e-5)


def test_prefixes_equal_fits_of_cut_series():
    series, cuts = some_series(6, 3), [10, 12, 31, 1000]
    y, live = smoothing._columns(series)
    levels, trends = smoothing.prefix_levels(y, live, cuts), smoothing.prefix_trends(y, live, cuts)
    for i, y in enumerate(series):
        for j, c in enumerate(cuts):
            alone = smoothing._columns([y[:c]])
            phi, level, trend, *_ = (x[0] for x in smoothing._fit_trend(*alone))
            assert trends[i, j] == pytest.approx((level, trend, phi))
            assert levels[i, j] == pytest.approx(smoothing._fit_ses(*alone)[2][0])


def test_passes_do_not_grow_with_cuts(monkeypatch):
    """Cuts share candidates: far fewer points are run through the series than one search for each cut would run."""
    y, live = smoothing._columns(some_series(5, 4)[:1])
    run = []
    states = smoothing._trend_states
    monkeypatch.setattr(smoothing, "_trend_states", lambda y, live, points, at=None: run.append(points.shape[-2] * len(live)) or states(y, live, points, at))
    smoothing.prefix_trends(y, live, [len(live)])
    one, cuts = sum(run), list(range(12, len(live) + 1))
    run.clear()
    smoothing.prefix_trends(y, live, cuts)
    assert sum(run) < one * len(cuts) / 3


def usage_of(spark, costs):
    rows = [(i, START + dt.timedelta(days=k), "gpt-4o", 10, 5, float(c)) for i, series in costs.items() for k, c in enumerate(series)]
    return spark.createDataFrame(rows, "project_id long, timestamp timestamp, model string, tokens_in long, tokens_out long, cost_usd double")


def test_backtest_with_cuts_above_a_thousand_and_large_ids(spark):
    rng = np.random.default_rng(5)
    costs = {1: 10 + rng.normal(size=1150), 2: rng.lognormal(1, 0.5, 1040), 2**62 + 1: [3.0] * 4, 7: [0.0, 0.0], 8: [2.0], 9: rng.lognormal(1, 0.2, 14)}
    cuts = [0, 1, 2, 5, 12, 1000, 1001, 1100]
    projects = [(i, f"p{i}", 9.0 if i != 8 else 0.0, 1200 if i < 3 else 20, 0.0) for i in costs]
    kinds = "project_id long, name string, baseline_daily_cost double, baseline_total_days int, baseline_total_cost double"
    got = {(r.project_id, r.cut): r for r in fc.backtest(usage_of(spark, costs), spark.createDataFrame(projects, kinds), cuts).collect()}
    assert len(got) == len(costs) * len(cuts)
    cut_costs = {k * 100 + j: [c for c in costs[p[0]] if c > 0][: cuts[j]] for k, p in enumerate(projects) for j in range(len(cuts))}
    alone = spark.createDataFrame([(k * 100 + j, *p[1:]) for k, p in enumerate(projects) for j in range(len(cuts))], kinds)
    for r in fc.core(usage_of(spark, cut_costs), alone).select("project_id", "projected_total").collect():
        p = projects[r.project_id // 100][0]
        x = got[p, cuts[r.project_id % 100]]
        assert x.projected_total == pytest.approx(r.projected_total, rel=1e-7), (p, x.cut)
        assert x.error == pytest.approx(abs(x.projected_total - float(np.sum(costs[p]))))


def test_smoothing_may_be_left_out_of_short_series(spark):
    usage = usage_of(spark, {1: [9.0, 11.0, 10.0, 12.0, 9.5], 2: [9.0 + i % 3 for i in range(12)], 3: [1.0, 2.0]})
    projects = spark.createDataFrame([(i, "p", 10.0, 14, 140.0) for i in (1, 2, 3)], "project_id long, name string, baseline_daily_cost double, baseline_total_days int, baseline_total_cost double")
    history = spark.createDataFrame([], "project_id long, iteration int, projected_total double")
    r = {x.project_id: x for x in fc.forecast(usage, projects, history, ses_min_points=10).collect()}
    assert r[1].models_used == ["linear"] and r[1].mase is None and r[1].prediction_interval_80 is None
    assert r[2].models_used == ["ses", "damped_trend", "linear"] and r[2].prediction_interval_80 is not None
    assert r[3].models_used == ["ema_fallback"]
