"""Short-series methods over an array column `series`: exponential smoothing, damped trend, regression.

Exponential smoothing is linear in its start level, so for a fixed smoothing factor the best start is a
quotient of sums; factors are searched on a grid, coarse then fine. The damped trend is linear in level
and trend, so each point is a 2 x 2 system; of a coarse grid the best point of each share of beta in alpha is refined in
turns. Both searches run in numpy over Arrow batches, TOGETHER series at a time; all else are Catalyst expressions.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

SES_POINTS, TREND_POINTS, LINE_POINTS = 2, 10, 3
FIXED_ALPHA = 0.3
TREND_ALPHAS = [0.0001, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.9999]
BETA_SHARES = [0.0, 0.1, 0.3, 0.6, 1.0]
PHIS = [0.80, 0.86, 0.92, 0.98]
TREND_TURNS = 6  # of the fine stage
TREND_STEPS = np.array([0.05, 0.15, 0.04])
TREND_LEAST, TREND_MOST = np.array([0.0001, 0.0, 0.80]), np.array([0.9999, 1.0, 0.98])
TOGETHER = 64


def regression(series: Column) -> Column:
    """struct<slope, intercept> of the series on 0, 1, ..., n - 1."""
    n = F.size(series).cast("double")
    sums = lambda f: F.aggregate(F.transform(series, f), F.lit(0.0), lambda s, v: s + v)
    sy, sxy = sums(lambda c, i: c), sums(lambda c, i: c * i)
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return F.struct(slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept"))


def _errors(series: Column, alpha: Column, level0: Column) -> Column:
    """struct<level, sq, ab>: final level, sums of squared and absolute errors."""
    kind = "struct<level:double,sq:double,ab:double>"
    start = F.struct(level0.alias("level"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("ab")).cast(kind)

    def step(s, c):
        e = c - s["level"]
        return F.struct((s["level"] + alpha * e).alias("level"), (s["sq"] + e * e).alias("sq"), (s["ab"] + F.abs(e)).alias("ab")).cast(kind)

    return F.aggregate(series, start, step)


def _ses_out(df: DataFrame) -> DataFrame:
    e = _errors(F.col("series"), F.col("alpha"), F.col("level0"))
    return df.withColumn("__e", e).select("project_id", "alpha", "level0", F.col("__e.level").alias("level"), F.col("__e.sq").alias("sse"), F.col("__e.ab").alias("sae"))


def ses_fixed(df: DataFrame, alpha: float = FIXED_ALPHA) -> DataFrame:
    """A fixed factor; the start is where the regression line begins (one step before the first point)."""
    line = regression(F.col("series"))
    x = df.filter(F.col("n") >= SES_POINTS).withColumn("alpha", F.lit(alpha)).withColumn("__l", line)
    return _ses_out(x.withColumn("level0", F.col("__l.intercept") - F.col("__l.slope")))


def trend_grid() -> np.ndarray:
    """Rows (alpha, share, phi) of the coarse stage, in the order in which ties are decided; beta is alpha * share."""
    return np.array([(a, b, p) for a in TREND_ALPHAS for b in BETA_SHARES for p in PHIS])


def trend_moves(turn: int) -> np.ndarray:
    """What a turn of the fine stage adds to (alpha, share, phi): a cube of three values each, half as wide each turn."""
    return np.array(list(itertools.product((-1, 0, 1), repeat=3))) * TREND_STEPS / 2**turn


def _columns(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series of falling length as a matrix, and how many of them are as long as each step."""
    lengths = np.array([len(y) for y in series])
    y = np.zeros((len(series), lengths[0]))
    for i, x in enumerate(series):
        y[i, : len(x)] = x
    return y, (lengths[:, None] > np.arange(lengths[0])).sum(0)


def _best_ses(y: np.ndarray, live: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each series the factor of least squared error (alphas: a row each, ascending) and its best start level."""
    a, dd, dw, ww = (np.zeros(alphas.shape) for _ in range(4))
    w = np.ones(alphas.shape)
    for t, k in enumerate(live):
        d = y[:k, t, None] - a[:k]
        a[:k] = (1 - alphas[:k]) * a[:k] + alphas[:k] * y[:k, t, None]
        dd[:k] += d * d
        dw[:k] += d * w[:k]
        ww[:k] += w[:k] * w[:k]
        w[:k] *= 1 - alphas[:k]
    at = np.arange(len(y)), np.round(dd - dw * dw / ww, 9).argmin(1)
    return alphas[at], (dw / ww)[at]


def _fit_ses(y: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
    """alpha, level0, level, sse, sae: hundredths first, then thousandths around the best; ties to the smaller."""
    near, _ = _best_ses(y, live, np.tile(np.arange(1, 100) / 100.0, (len(y), 1)))
    around = np.clip(np.round(near[:, None] + np.arange(-10, 11) / 1000.0, 3), 0.001, 0.999)
    alpha, level0 = _best_ses(y, live, around)
    level, sq, ab = level0.copy(), np.zeros(len(y)), np.zeros(len(y))
    for t, k in enumerate(live):
        e = y[:k, t] - level[:k]
        level[:k] += alpha[:k] * e
        sq[:k] += e * e
        ab[:k] += np.abs(e)
    return [alpha, level0, level, sq, ab]


def _trend_states(y: np.ndarray, live: np.ndarray, points: np.ndarray, at: list[int] | None = None) -> list[tuple[np.ndarray, ...]]:
    """sse, level, trend of each series for each of its points (rows x points x 3), with the best start level and trend.

    Three recursions side by side: the series from zero, and no series from a level or a trend of one. at: lengths after which
    the states are taken (shorter series at their end), ascending; else once, each series at its end.
    """
    alpha, phi = points[..., 0], points[..., 2]
    beta = alpha * points[..., 1]
    zero, one = np.zeros(alpha.shape), np.ones(alpha.shape)
    level, trend = np.stack([zero, one, zero]), np.stack([zero, zero, one])
    sums = np.zeros((6, *alpha.shape))  # of products of the three errors: 00, 01, 02, 11, 12, 22
    due, out = collections.Counter([len(live)] if at is None else [min(c, len(live)) for c in at]), []
    for t, k in enumerate(live):
        a, b, p = alpha[:k], beta[:k], phi[:k]
        e = -level[:, :k] - p * trend[:, :k]
        e[0] = y[:k, t, None] - level[0, :k] - p * trend[0, :k]
        level[:, :k], trend[:, :k] = level[:, :k] + p * trend[:, :k] + a * e, p * trend[:, :k] + b * e
        for s, (i, j) in zip(sums, ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
            s[:k] += e[i] * e[j]
        for _ in range(due[t + 1]):
            s00, s01, s02, s11, s12, s22 = sums
            det = s11 * s22 - s12 * s12
            sound = np.abs(det) > 1e-12
            safe = np.where(sound, det, 1.0)
            l0 = np.where(sound, (-s01 * s22 + s02 * s12) / safe, 0.0)
            b0 = np.where(sound, (-s02 * s11 + s01 * s12) / safe, 0.0)
            sse = s00 + 2 * l0 * s01 + 2 * b0 * s02 + l0 * l0 * s11 + 2 * l0 * b0 * s12 + b0 * b0 * s22
            out.append((sse, level[0] + l0 * level[1] + b0 * level[2], trend[0] + l0 * trend[1] + b0 * trend[2]))
    return out


def _moved(points: np.ndarray, turn: int) -> np.ndarray:
    """The candidates around each point, within bounds."""
    return np.clip(points[..., None, :] + trend_moves(turn), TREND_LEAST, TREND_MOST)


def _best_point(sse: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Place of the least error on the last axis; ties to the smaller parameters."""
    return np.lexsort((points[..., 2], points[..., 1], points[..., 0], np.round(sse, 6)))[..., 0]


def _fit_trend(y: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
    """phi, level, trend, sse, alpha, beta. Coarse: the best grid point of each share. Fine: each of these moves to the best
    of a cube of candidates around it, which halves each turn; then the best of all.
    """
    grid, rows = trend_grid(), np.arange(len(y))[:, None]
    sse = np.round(_trend_states(y, live, np.tile(grid, (len(y), 1, 1)))[0][0], 6)
    at = np.stack([np.where(grid[:, 1] == share, sse, np.inf).argmin(1) for share in BETA_SHARES], 1)
    points = grid[at]
    for turn in range(TREND_TURNS):
        around = _moved(points, turn)
        found = [x.reshape(around.shape[:-1]) for x in _trend_states(y, live, around.reshape(len(y), -1, 3))[0]]
        best = np.round(found[0], 6).argmin(2)[..., None]  # candidates come in the order of ties
        points = np.take_along_axis(around, best[..., None], 2)[:, :, 0]
        sse, level, trend = (np.take_along_axis(x, best, 2)[..., 0] for x in found)
    best = _best_point(sse, points)[:, None]
    sse, level, trend, points = (x[rows, best][:, 0] for x in (sse, level, trend, points))
    alpha, share, phi = points.T
    return [phi, level, trend, sse, alpha, alpha * share]


def prefix_levels(y: np.ndarray, live: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The level of the searched exponential smoothing of each series after each cut: one pass with a state for each thousandth."""
    alphas, rows = np.arange(1, 1000) / 1000.0, np.arange(len(y))
    coarse = np.arange(10, 1000, 10) - 1
    a, dd, dw, ww = (np.zeros((len(y), len(alphas))) for _ in range(4))
    w, out, due = np.ones((len(y), len(alphas))), [], collections.Counter(min(c, len(live)) for c in cuts)
    for t, k in enumerate(live):
        d = y[:k, t, None] - a[:k]
        a[:k] = (1 - alphas) * a[:k] + alphas * y[:k, t, None]
        dd[:k] += d * d
        dw[:k] += d * w[:k]
        ww[:k] += w[:k] * w[:k]
        w[:k] *= 1 - alphas
        for _ in range(due[t + 1]):
            error = np.round(dd - dw * dw / ww, 9)
            near = coarse[error[:, coarse].argmin(1)]
            around = np.clip(near[:, None] + np.arange(-10, 11), 0, len(alphas) - 1)
            at = rows, around[rows, np.take_along_axis(error, around, 1).argmin(1)]
            out.append(a[at] + w[at] * dw[at] / ww[at])
    return np.stack(out, 1)


def _distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct points, filled up with its first, and where in them each point is. Points lie on a lattice."""
    scaled = np.round((points - [0, 0, TREND_LEAST[2]]) * [1e7, 1e7, 1e5]).astype(np.int64)
    keys = (scaled[..., 0] << 39 | scaled[..., 1] << 15 | scaled[..., 2]).reshape(len(points), -1)
    flat, where, found = points.reshape(len(points), -1, 3), np.zeros(keys.shape, np.int64), []
    for i, k in enumerate(keys):
        _, first, where[i] = np.unique(k, return_index=True, return_inverse=True)
        found.append(flat[i, first])
    out = np.stack([np.concatenate((f, np.repeat(f[:1], max(map(len, found)) - len(f), 0))) for f in found])
    return out, where.reshape(points.shape[:-1])


def prefix_trends(y: np.ndarray, live: np.ndarray, cuts: list[int]) -> np.ndarray:
    """(level, trend, phi) of the damped trend of each series after each cut, by the stages of _fit_trend.

    A candidate of any cut is run through the series once and its states are taken at all cuts, so what cuts have in common
    (the whole coarse stage, and most candidates of neighbouring cuts) is computed once.
    """
    grid = trend_grid()
    row, cut = np.arange(len(y))[:, None, None, None], np.arange(len(cuts))[:, None, None]
    sse = np.round(np.stack([s[0] for s in _trend_states(y, live, np.tile(grid, (len(y), 1, 1)), cuts)], 1), 6)
    points = grid[np.stack([np.where(grid[:, 1] == share, sse, np.inf).argmin(2) for share in BETA_SHARES], 2)]
    for turn in range(TREND_TURNS):
        around = _moved(points, turn)
        distinct, where = _distinct(around)
        found = [np.stack(x, 1)[row, cut, where] for x in zip(*_trend_states(y, live, distinct, cuts))]
        best = np.round(found[0], 6).argmin(3)[..., None]
        points = np.take_along_axis(around, best[..., None], 3)[:, :, :, 0]
        sse, level, trend = (np.take_along_axis(x, best, 3)[..., 0] for x in found)
    best = _best_point(sse, points)[..., None]
    return np.stack([np.take_along_axis(x, best, 2)[..., 0] for x in (level, trend, points[..., 2])], 2)


SES_FIT = "fit_alpha double, fit_level0 double, fit_level double, fit_sse double, fit_sae double"
TREND_FIT = "phi double, trend_level double, trend double, trend_sse double, trend_alpha double, trend_beta double"


def fitted(df: DataFrame, ses_least: int = TREND_POINTS) -> DataFrame:
    """df with the columns of both searched fits (null for shorter series): many series at a time, no shuffle."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{SES_FIT}, {TREND_FIT}").fields])
    at, width = df.columns.index("series"), len(schema) - len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(start, TOGETHER)
                series = [np.asarray(s, float) for s in b.column(at).to_pylist()]
                out = np.full((width, b.num_rows), np.nan)
                for fit, least, rows in ((_fit_ses, ses_least, slice(0, 5)), (_fit_trend, TREND_POINTS, slice(5, width))):
                    picked = sorted((i for i, s in enumerate(series) if len(s) >= least), key=lambda i: -len(series[i]))
                    if picked:
                        out[rows, picked] = np.stack(fit(*_columns([series[i] for i in picked])))
                cols = [pa.array(x, from_pandas=True) for x in out]  # NaN: null
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], schema.names)

    return df.mapInArrow(run, schema)


def ses_optimal(df: DataFrame, least: int = TREND_POINTS) -> DataFrame:
    """Least squares over factors 0.01 ... 0.99, then thousandths around the best; ties to the smaller."""
    x = fitted(df.filter(F.col("n") >= least).select("project_id", "series"), least)
    return x.select("project_id", *[F.col(f"fit_{c}").alias(c) for c in ("alpha", "level0", "level", "sse", "sae")])


def ses(df: DataFrame) -> DataFrame:
    """The searched fit, or the fixed factor for short series."""
    return ses_fixed(df.filter(F.col("n") < TREND_POINTS)).unionByName(ses_optimal(df))


def with_ses(x: DataFrame, least: int = SES_POINTS) -> DataFrame:
    """Adds ses_level, sse and sae to fitted rows: the searched fit, or the fixed factor for short series of `least` points or more."""
    line = regression(F.col("series"))
    short = _errors(F.col("series"), F.lit(FIXED_ALPHA), line["intercept"] - line["slope"])
    x = x.withColumn("__e", F.when((F.col("n") >= least) & F.col("fit_level").isNull(), short))
    return x.withColumns({to: F.coalesce(f"fit_{c}", f"__e.{e}") for to, c, e in (("ses_level", "level", "level"), ("sse", "sse", "sq"), ("sae", "sae", "ab"))}).drop("__e")


def damped_trend(df: DataFrame) -> DataFrame:
    """project_id, phi, level, trend, sse, alpha, beta for series of ten points or more."""
    x = fitted(df.filter(F.col("n") >= TREND_POINTS).select("project_id", "series"))
    return x.select("project_id", "phi", F.col("trend_level").alias("level"), "trend", *[F.col(f"trend_{c}").alias(c) for c in ("sse", "alpha", "beta")])


def linear(df: DataFrame) -> DataFrame:
    return df.filter(F.col("n") >= LINE_POINTS).withColumn("l", regression(F.col("series"))).select("project_id", "l.slope", "l.intercept")


def ema_state(daily: Column, base: Column) -> Column:
    """Burn ratio smoothed from 1 over the active days; the factor grows with their number."""
    alpha = F.least(F.lit(0.6), F.lit(0.15) + 0.03 * F.size(daily))
    return F.aggregate(daily, F.lit(1.0), lambda s, c: alpha * c / base + (1 - alpha) * s)


def ema(df: DataFrame) -> DataFrame:
    ratio = ema_state(F.col("daily"), F.col("base"))
    return df.withColumn("ratio", ratio).select("project_id", "ratio", F.greatest(F.lit(0.0), F.col("ratio") * F.col("base")).alias("daily_forecast"), "remaining_days")
