"""The forecast of every project in one job: a row per project, members as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from costloom.operators import smoothing
from costloom.operators.aggregates import model_costs
from costloom.operators.series import series_choice
from costloom.session import stored
from costloom.sources import tables

Z80, Z95 = 1.28, 1.96
OVER, UNDER, RUN, RECENT = 1.5, 0.5, 3, 5


def members(choice: DataFrame, ses_min_points: int = smoothing.SES_POINTS) -> DataFrame:
    """Adds each member's forecast per step (null where it does not run) and residual sums: no shuffle, no join.

    ses_min_points: exponential smoothing stays out below so many points, and with it intervals and accuracy, which are about it.
    """
    x = smoothing.with_ses(smoothing.fitted(choice, max(ses_min_points, smoothing.TREND_POINTS)), ses_min_points)
    line_fit = F.when(F.col("n") >= smoothing.LINE_POINTS, smoothing.regression(F.col("series")))
    x = x.withColumn("__l", line_fit).withColumns({"slope": F.col("__l.slope"), "intercept": F.col("__l.intercept")}).drop("__l")
    steps = F.sequence(F.lit(1), F.col("horizon"))
    zero = F.lit(0.0)
    phi = F.col("phi")
    damped = lambda h: F.greatest(zero, F.col("trend_level") + F.col("trend") * phi * (1 - F.pow(phi, h)) / (1 - phi))
    line = lambda h: F.greatest(zero, F.col("intercept") + F.col("slope") * (F.col("n") + h - 1))
    x = x.withColumn("ses", F.when(F.col("ses_level").isNotNull(), F.transform(steps, lambda h: F.greatest(zero, F.col("ses_level")))))
    x = x.withColumn("damped_trend", F.when(F.col("trend_level").isNotNull(), F.transform(steps, damped)))
    return x.withColumn("linear", F.when(F.col("intercept").isNotNull(), F.transform(steps, line)))


MEMBERS = ("ses", "damped_trend", "linear")


def ensemble(x: DataFrame) -> DataFrame:
    """Adds models_used and `steps`: the plain mean of the members; the EMA's flat line where none ran."""
    names = F.filter(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in MEMBERS]), lambda m: m.isNotNull())
    # missing members as empty arrays, not as an element of an index: an index past a null array is null too
    n = F.size(names)
    total = lambda i: sum((F.coalesce(F.get(F.col(m), i), F.lit(0.0)) for m in MEMBERS), F.lit(0.0))
    steps = F.transform(F.sequence(F.lit(0), F.col("horizon") - 1), lambda i: total(i) / n)
    ratio = smoothing.ema_state(F.col("daily"), F.col("base"))
    flat = F.array_repeat(F.greatest(F.lit(0.0), ratio * F.col("base")), F.col("remaining_days"))
    x = x.withColumn("ema_ratio", ratio).withColumn("models_used", F.when(n > 0, names).otherwise(F.array(F.lit("ema_fallback"))))
    return x.withColumn("ran", n > 0).withColumn("steps", F.when(n > 0, steps).otherwise(flat))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def totals(x: DataFrame) -> DataFrame:
    mean_step = _sum(F.col("steps")) / F.size("steps")
    by_bucket = mean_step * F.col("buckets_per_day") * F.col("remaining_days")
    x = x.withColumn("projected_remaining", F.when(F.col("ran") & F.col("use_buckets"), by_bucket).otherwise(_sum(F.col("steps"))))
    ratio = F.col("projected_remaining") / F.col("remaining_days") / F.col("base")
    x = x.withColumn("smoothed_burn_ratio", F.when(F.col("ran"), ratio).otherwise(F.col("ema_ratio")))
    return x.withColumn("projected_total", F.col("actual_spend") + F.col("projected_remaining"))


def intervals(x: DataFrame) -> DataFrame:
    """Bands widen with the root of the day and are clamped day by day before they are summed."""
    sigma = F.sqrt(F.col("sse") / F.col("n"))
    daily = sigma * F.when(F.col("use_buckets"), F.sqrt("buckets_per_day")).otherwise(1.0)
    mean = F.col("projected_remaining") / F.col("remaining_days")
    days = F.sequence(F.lit(1), F.col("remaining_days"))

    def side(z: float, sign: int) -> Column:
        band = F.transform(days, lambda h: F.greatest(F.lit(0.0) if sign < 0 else F.lit(float("-inf")), mean + sign * z * daily * F.sqrt(h)))
        return F.col("actual_spend") + _sum(band)

    known = (F.col("n") >= 2) & (F.col("sse") > 0)
    for name, z in (("80", Z80), ("95", Z95)):
        x = x.withColumn(f"prediction_interval_{name}", F.when(known, F.struct(side(z, -1).alias("lower"), side(z, 1).alias("upper"))))
    return x


def accuracy(x: DataFrame) -> DataFrame:
    mae = F.when(F.col("n") >= 2, F.col("sae") / F.col("n"))
    moves = F.zip_with(F.slice("series", F.lit(2), F.greatest(F.lit(0), F.col("n") - 1)), F.slice("series", F.lit(1), F.greatest(F.lit(0), F.col("n") - 1)), lambda a, b: F.abs(a - b))
    naive = _sum(moves) / (F.col("n") - 1)
    mase = F.when((F.col("n") >= 3) & (naive > 0), mae / naive)
    x = x.withColumn("mase", mase).withColumn("mae_dollars", mae * F.col("remaining_days"))
    return x.withColumn("beats_naive", F.coalesce(F.col("mase") < 1, F.lit(False)))


def drift(x: DataFrame) -> DataFrame:
    recent = F.slice(F.reverse("daily"), F.lit(1), F.lit(RECENT))

    def trailing(test) -> Column:
        """Length of the run of last days that pass."""
        kind = "struct<n:int,open:boolean>"
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")).cast(kind)
        go = lambda s, c: s["open"] & test(c / F.col("base"))
        return F.aggregate(recent, start, lambda s, c: F.struct((s["n"] + go(s, c).cast("int")).alias("n"), go(s, c).alias("open")).cast(kind))["n"]

    over, under = trailing(lambda r: r > OVER), trailing(lambda r: r < UNDER)
    ratio = F.col("smoothed_burn_ratio")
    status = F.when((ratio > OVER) & (over >= RUN), "over_budget").when((ratio < UNDER) & (under >= RUN), "under_budget")
    return x.withColumn("drift_status", status.otherwise("on_track"))


def confidence_of(days: Column) -> Column:
    return F.when(days == 0, "low").when(days <= 3, "medium-low").when(days <= 7, "medium").when(days <= 14, "high").otherwise("very-high")


def stability(x: DataFrame, history: DataFrame) -> DataFrame:
    """Mean change in percent over the last five totals, this one included."""
    recent = F.when(F.col("rank") < RECENT, F.struct("iteration", "projected_total"))
    ranked = history.withColumn("rank", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("iteration"))))
    runs = ranked.groupBy("project_id").agg(F.array_sort(F.collect_list(recent)).alias("__before"), F.count(F.lit(1)).alias("__runs"))
    x = x.join(runs, "project_id", "left")
    totals_of = F.concat(F.coalesce(F.transform("__before", lambda r: r["projected_total"]), F.array().cast("array<double>")), F.array("projected_total"))
    x = x.withColumn("__totals", totals_of)
    n = F.size("__totals")
    change = lambda a, b: F.abs(b - a) / F.greatest(b, F.lit(0.001)) * 100
    changes = F.filter(F.zip_with(F.slice("__totals", F.lit(1), n - 1), F.slice("__totals", F.lit(2), n - 1), change), lambda c: c.isNotNull())
    x = x.withColumn("__changes", changes).withColumn("stability", F.when(F.size("__changes") > 0, _sum(F.col("__changes")) / F.size("__changes")))
    label = F.when(F.col("stability") < 5, "converged").when(F.col("stability") <= 15, "stabilizing").when(F.col("stability").isNotNull(), "adjusting")
    x = x.withColumn("stability_label", label).withColumn("iteration", (F.coalesce("__runs", F.lit(0)) + 1).cast("int"))
    return x.drop("__runs", "__before", "__totals", "__changes")


MODEL_SHARE = "array<struct<model:string,spent:double,projected:double,share:double>>"


def with_breakdown(x: DataFrame, usage: DataFrame) -> DataFrame:
    """Adds model_breakdown: each model's part of what was spent and is projected; empty where nothing was spent."""
    costs = model_costs(usage).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("model", "cost"))).alias("__costs"))
    share = lambda c: c["cost"] / F.col("actual_spend")
    each = F.transform("__costs", lambda c: F.struct(c["model"].alias("model"), c["cost"].alias("spent"), (c["cost"] + share(c) * F.col("projected_remaining")).alias("projected"), share(c).alias("share")))
    x = x.join(costs, "project_id", "left")
    return x.withColumn("model_breakdown", F.coalesce(F.when(F.col("actual_spend") > 0, each), F.array().cast(MODEL_SHARE))).drop("__costs")


def model_breakdown(x: DataFrame, usage: DataFrame) -> DataFrame:
    """project_id, model, spent, share, projected; none for projects that have spent nothing."""
    rows = with_breakdown(x, usage).select("project_id", F.explode("model_breakdown").alias("m"))
    return rows.select("project_id", "m.model", "m.spent", "m.share", "m.projected")


def core(usage: DataFrame, projects: DataFrame, ses_min_points: int = smoothing.SES_POINTS) -> DataFrame:
    """Everything that needs neither the history nor the models."""
    x = drift(accuracy(intervals(totals(ensemble(members(series_choice(usage, projects), ses_min_points))))))
    return x.withColumn("confidence", confidence_of(F.col("active_days")))


FIELDS = [
    "project_id", "project_name", "actual_spend", "total_tokens", "projected_total", "projected_remaining", "remaining_days", "active_days", "data_points",
    "data_granularity", "total_days", "smoothed_burn_ratio", "drift_status", "confidence", "stability", "stability_label", "model_breakdown", "iteration",
    "baseline_daily_cost", "baseline_total_cost", "prediction_interval_80", "prediction_interval_95", "mase", "mae_dollars", "n_models_used", "models_used",
]


def forecast(usage: DataFrame, projects: DataFrame, history: DataFrame, ses_min_points: int = smoothing.SES_POINTS) -> DataFrame:
    """The complete record. projects: project_id, name, baseline_daily_cost, baseline_total_days, baseline_total_cost."""
    x = with_breakdown(stability(core(usage, projects, ses_min_points), history), usage)
    x = x.withColumns({"project_name": F.col("name"), "data_points": F.col("n"), "total_days": F.col("baseline_total_days"), "n_models_used": F.size("models_used")})
    return x.select(*FIELDS)


def for_projects(usage: DataFrame, projects: DataFrame, history: DataFrame, ids: DataFrame) -> DataFrame:
    """forecast() of the named projects (ids: project_id); whatever reads or writes it fails if one is not known."""
    wanted = ids.select("project_id").distinct()
    found = wanted.join(projects.withColumn("__known", F.lit(True)), "project_id", "left")
    message = F.concat(F.lit("project "), F.col("project_id").cast("string"), F.lit(" not found"))
    known = tables.checked(found, F.col("__known").isNull(), message).drop("__known")
    pick = lambda df: df.join(wanted, "project_id", "left_semi")
    return forecast(pick(usage), known, pick(history))


def as_history(record: DataFrame) -> DataFrame:
    """A forecast as rows of the forecasts table (without the time of writing)."""
    return record.select(
        "project_id", "iteration", "projected_total", F.col("remaining_days").alias("projected_remaining_days"), "smoothed_burn_ratio", "confidence",
        F.col("active_days").alias("active_days_count"), "mase",
    )


def run(usage: DataFrame, projects: DataFrame, history: DataFrame, save_to: str | None = None) -> DataFrame:
    """The plain report. With save_to the record is computed once, kept, and appended to the history from there."""
    record = forecast(usage, projects, history)
    if save_to:
        record = stored(record)
        as_history(record).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(save_to)
    return record


def _at_cuts(series: list[np.ndarray], cuts: list[int], bases: list[float], days: list[int]) -> np.ndarray:
    """What is projected in all after the first so many active days, for each series and cut: prefixes share one pass."""
    out = np.zeros((len(series), len(cuts)))
    long = sorted({c for c in cuts if c >= smoothing.TREND_POINTS})
    picked = sorted((i for i, y in enumerate(series) if len(y) >= smoothing.TREND_POINTS), key=lambda i: -len(series[i]))
    levels, trends = {}, {}
    if long and picked:
        y, live = smoothing._columns([series[i] for i in picked])
        for i, at_level, at_trend in zip(picked, smoothing.prefix_levels(y, live, long), smoothing.prefix_trends(y, live, long)):
            levels[i], trends[i] = dict(zip(long, at_level)), dict(zip(long, at_trend))
    for i, y in enumerate(series):
        sum_y, sum_xy = (np.concatenate(([0.0], np.cumsum(v))) for v in (y, np.arange(len(y)) * y))
        for j, c in enumerate(cuts):
            n = min(c, len(y))
            left = max(1, days[i] - n)
            h, steps = np.arange(1, left + 1), []
            sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
            slope = (n * sum_xy[n] - sx * sum_y[n]) / (n * sxx - sx * sx) if n >= smoothing.SES_POINTS else 0.0
            start = (sum_y[n] - slope * sx) / n if n else 0.0
            if n >= smoothing.TREND_POINTS:
                level, trend, phi = trends[i][c]
                steps += [np.full(left, levels[i][c]), level + trend * phi * (1 - phi**h) / (1 - phi)]
            elif n >= smoothing.SES_POINTS:
                level = start - slope
                for v in y[:n]:
                    level += smoothing.FIXED_ALPHA * (v - level)
                steps.append(np.full(left, level))
            if n >= smoothing.LINE_POINTS:
                steps.append(start + slope * (n + h - 1))
            if steps:
                remaining = np.maximum(np.stack(steps), 0).mean(0).sum()
            else:
                ratio = 1.0  # as smoothing.ema_state, of one day at most
                for v in y[:n]:
                    ratio += min(0.6, 0.15 + 0.03 * n) * (v / bases[i] - ratio)
                remaining = max(0.0, ratio * bases[i]) * left
            out[i, j] = sum_y[n] + remaining
    return out


def backtest(usage: DataFrame, projects: DataFrame, cuts: list[int]) -> DataFrame:
    """The forecast after each number of active days, against what was spent in all: one job for all cuts.

    A project is one row with its days in order (bounded by the calendar). Its prefixes are not copied: one pass keeps
    the states of smoothing, trend and regression at every cut.
    """
    days = usage.groupBy("project_id", F.to_date("timestamp").alias("day")).agg(F.sum("cost_usd").alias("cost"))
    paid = F.when(F.col("cost") > 0, F.struct("day", "cost"))
    series = days.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(paid)), lambda s: s["cost"]).alias("daily"), F.sum("cost").alias("actual_total"))
    base = F.when(F.col("baseline_daily_cost") > 0, F.col("baseline_daily_cost")).otherwise(1.0).alias("base")
    rows = projects.select("project_id", base, "baseline_total_days").join(series, "project_id").select("project_id", "daily", "actual_total", "base", F.coalesce("baseline_total_days", F.lit(0)).alias("days"))
    kept = StructType(rows.schema.fields[:1] + rows.schema.fields[2:3])
    schema = StructType([*kept.fields, *StructType.fromDDL("cut int, projected_total double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(s, smoothing.TOGETHER) for whole in batches for s in range(0, whole.num_rows, smoothing.TOGETHER)):
            daily, bases, days = (b.column(c).to_pylist() for c in ("daily", "base", "days"))
            total = _at_cuts([np.asarray(y, float) for y in daily], cuts, bases, days).ravel()
            each = pa.array(np.repeat(np.arange(b.num_rows), len(cuts)))
            yield pa.RecordBatch.from_arrays(
                [b.column("project_id").take(each), b.column("actual_total").take(each), pa.array(cuts * b.num_rows, pa.int32()), pa.array(total, pa.float64())], schema.names
            )

    x = rows.mapInArrow(run, schema).select("project_id", "cut", "projected_total", "actual_total")
    error = F.abs(F.col("projected_total") - F.col("actual_total"))
    return x.withColumn("error", error).withColumn("error_pct", F.try_divide("error", "actual_total") * 100)
