"""Registered queries over the given tables; `oracles` has the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType

from costloom.functions import dims, pricing
from costloom.operators import aggregates as agg, forecast as fc, optimize, reports, scope, series, smoothing
from costloom.plans import oracles, views
from costloom.session import new_dir
from costloom.sources import ingest, schemas, tables
from costloom.streaming import live

CUTS = [5, 10, 20]
PERIOD = tuple(map(dt.datetime.fromisoformat, oracles.PERIOD))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Sums of doubles differ in their last digits between engines."""

    def shown(f):
        if isinstance(f.dataType, DoubleType):
            return F.round(f.name, places).alias(f.name)
        return F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, DateType) else F.col(f.name)

    return df.select(*map(shown, df.schema.fields))


def _usage(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: rounded(f(views.usage(spark, d)))


def _users(f: Callable[..., DataFrame]):
    """f(usage, projects, history) on a project for each user."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        u = views.user_usage(spark, d)
        return rounded(f(u, views.projects(u), views.history(u)))

    return query


def _choice(f: Callable[[DataFrame], DataFrame]):
    return _users(lambda u, p, h: f(series.series_choice(u, p)))


def _core(*names: str):
    return _users(lambda u, p, h: fc.core(u, p).select("project_id", *names))


def _record(f: Callable[[DataFrame, DataFrame], DataFrame]):
    return _users(lambda u, p, h: f(fc.forecast(u, p, h), p))


def flat(record: DataFrame) -> DataFrame:
    """A record with its intervals as columns and its models as text."""
    out = record
    for z in ("80", "95"):
        for side in ("lower", "upper"):
            out = out.withColumn(f"pi{z}_{side}", F.col(f"prediction_interval_{z}.{side}"))
    out = out.withColumn("models_used", F.array_join("models_used", ",")).withColumn("breakdown_models", F.size("model_breakdown"))
    return out.drop("prediction_interval_80", "prediction_interval_95", "model_breakdown")


def _document(record: DataFrame, projects: DataFrame) -> DataFrame:
    """JSON records, read back."""
    field = lambda name: F.get_json_object("document", f"$.{name}")
    texts, numbers = ("project_name", "drift_status"), ("actual_spend", "projected_total", "smoothed_burn_ratio", "mase")
    lists = {"models_used": F.array_join(F.from_json(field("models_used"), "array<string>"), ","), "breakdown_models": F.json_array_length(field("model_breakdown"))}
    return reports.as_json(record).select("project_id", *[field(c).alias(c) for c in texts], *[field(c).cast("double").alias(c) for c in numbers], *[v.alias(k) for k, v in lists.items()], F.size(F.json_object_keys("document")).alias("fields"))


def _price_catalog(spark, d):
    listed = pricing.catalog(spark)
    names = [m for m, *_ in dims.PRICE_ROWS]
    used = views.usage(spark, d).filter(F.col("model").isin(names)).groupBy("model").agg(F.count(F.lit(1)).alias("calls"))  # a row a listed name at most
    return listed.join(F.broadcast(used), "model", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def _models(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(views.calls(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("calls")))


def _resolve(counts: DataFrame) -> DataFrame:
    return pricing.resolve_models(counts.select("model")).join(counts, "model")


def _ingested(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: rounded(f(views.raw(spark, d)).drop("metadata"), 6)


def _streamed(spark: SparkSession, d: str) -> tuple[str, str]:
    """Where a stream of all responses has put its usage rows, and a folder for further streams' checkpoints."""
    place = new_dir(spark)
    live.start_ingest(views.raw_stream(spark, d), f"{place}/usage", f"{place}/state", once=True).awaitTermination()
    return f"{place}/usage", place


def _stream_ingest(spark, d):
    usage, _ = _streamed(spark, d)
    return rounded(spark.read.parquet(usage).drop("metadata", "day", "batch"), 6)


def _usage_stream(spark: SparkSession, usage: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(usage).schema).parquet(usage)


def _live(spark: SparkSession, d: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of the usage rows as a stream, once through, kept as a table of files."""
    usage, place = _streamed(spark, d)
    rows = f(_usage_stream(spark, usage))
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", f"{place}/live").format("parquet").option("path", f"{place}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(rows.schema).parquet(f"{place}/out"), 6)


def _stream_totals(spark, d):
    usage, place = _streamed(spark, d)
    live.start_totals(_usage_stream(spark, usage), f"{place}/totals", f"{place}/live", once=True).awaitTermination()
    return rounded(live.read_totals(spark, f"{place}/totals"), 6)


def _ingest_counts(spark, d):
    """Counts by status from the job that appends the usage rows, and the rows that are there."""
    place = new_dir(spark)
    counts = ingest.append_ingested(views.raw(spark, d), place)
    stored_rows = tables.read_usage(spark, place).agg(F.count(F.lit(1)).alias("stored"))
    return stored_rows.select(*[F.lit(counts[s]).cast("long").alias(s) for s in ingest.STATUSES], "stored")


def _appended(spark: SparkSession, d: str) -> str:
    place = new_dir(spark)
    tables.append_usage(views.usage(spark, d).select(*schemas.USAGE.names), place)
    return place


def _usage_period(spark, d):
    rows = tables.read_usage(spark, _appended(spark, d), *PERIOD)
    return rounded(rows.drop("metadata"), 6)


def _purge_stored(spark, d):
    place = _appended(spark, d)
    rows = tables.read_usage(spark, place)
    tables.purge_stored(spark, place, rows.filter(F.col("project_id") % 2 == 0).select("project_id").distinct())
    return agg.project_totals(tables.read_usage(spark, place)).transform(rounded)


def _old_usage(spark, d):
    """Rows that were stored before they had a source."""
    place = new_dir(spark)
    views.usage(spark, d).select(*schemas.USAGE.names).drop("source").write.parquet(place)
    return rounded(tables.read_usage(spark, place).groupBy("project_id", "source").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("spend")))


def _export_json(spark, d):
    place = new_dir(spark)
    rows = tables.newest(views.usage(spark, d), 1000, "project_id").select(*schemas.JSON_COLUMNS)
    tables.write_json(rows, place)
    return rounded(spark.read.schema(rows.schema).json(place).drop("metadata"), 6)


def _add_projects(spark, d):
    p = views.projects(views.usage(spark, d))
    known = F.col("project_id") % 2 == 0
    return rounded(tables.add_projects(p.filter(~known), p.filter(known)).select("project_id", "name", "path", "baseline_daily_cost"))


def _save_run(u, p, h):
    place = new_dir(u.sparkSession)
    fc.run(u, p, h, place)
    return u.sparkSession.read.parquet(place).drop("created_at")


def _matrix(spark, d):
    return pricing.calc(views.prompts(spark, d), calls=10)


def _ensemble(u, p, h):
    x = fc.totals(fc.ensemble(fc.members(series.series_choice(u, p))))
    return x.select("project_id", F.array_join("models_used", ",").alias("models_used"), F.size("steps").alias("steps"), F.get("steps", F.lit(0)).alias("first_step"), "projected_remaining", "projected_total")


def _purged(spark, d):
    u = views.usage(spark, d)
    gone = agg.project_totals(u).filter(F.col("project_id") % 2 == 0)
    return agg.project_totals(tables.purge(u, gone)).transform(rounded)


def _lookup(spark, d):
    found = tables.project_lookup(views.projects(views.usage(spark, d)))
    return found.select("project_id", "path", "name", F.col("metadata.project_type").alias("project_type"), F.coalesce("metadata.calls_per_day", F.lit(0)).alias("calls_per_day"), F.col("metadata.budget").alias("budget"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # pricing
    "price_catalog": _price_catalog,
    "resolve_model": _models(_resolve),
    "usage_cost": lambda s, d: rounded(views.usage(s, d).select("id", "project_id", "model", "tokens_in", "tokens_out", "cost_usd"), 9),
    "model_tier": _models(pricing.with_tier),
    "model_provider": _models(lambda c: c.withColumn("provider", pricing.provider_of(F.col("model")))),
    "unknown_models": lambda s, d: pricing.unknown_models(views.calls(s, d)),
    "token_estimate": lambda s, d: views.prompts(s, d).select("prompt_id", pricing.token_estimate(F.coalesce("prompt", F.lit(""))).alias("tokens")),
    "calc_matrix": lambda s, d: rounded(_matrix(s, d), 9),
    "calc_extremes": lambda s, d: rounded(pricing.calc_extremes(_matrix(s, d))),
    # aggregates
    "daily_costs": _usage(agg.daily_costs),
    "bucketed_costs": _usage(lambda u: agg.bucketed_costs(u, 15)),
    "bucketed_costs_7": _usage(lambda u: agg.bucketed_costs(u, 7)),
    "active_days": _usage(agg.active_days),
    "project_totals": _usage(agg.project_totals),
    "model_costs": _usage(agg.model_costs),
    "model_tokens": _usage(agg.model_tokens),
    "model_profile": _usage(lambda u: agg.model_profile(u).drop("short_calls", "short_cost")),
    "short_outputs": _usage(lambda u: agg.model_profile(u).select("project_id", "model", "short_calls", "short_cost")),
    "session_summary": _usage(agg.session_summary),
    "active_series": _users(lambda u, p, h: agg.active(agg.daily_costs(u))),
    # newest rows
    "recent_usage": _usage(lambda u: tables.newest(u, 20, "project_id").select("project_id", "id", "timestamp", "model", "tokens_in", "tokens_out", "cost_usd", "rank")),
    "recent_five": _usage(lambda u: tables.newest(u, 5, "project_id").select("project_id", "id", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), "rank")),
    "last_14_days": _usage(lambda u: agg.last_days(agg.daily_costs(u))),
    "forecast_history": _users(lambda u, p, h: tables.forecast_history(h)),
    "forecast_tail": _users(lambda u, p, h: agg.last_runs(h, 10)),
    "convergence": _users(lambda u, p, h: agg.convergence(h)),
    "export_usage": _usage(tables.export_usage),
    "purge_usage": _purged,
    "purge_stored": _purge_stored,
    "usage_period": _usage_period,
    "old_usage": _old_usage,
    "export_json": _export_json,
    "add_projects": _add_projects,
    "project_lookup": _lookup,
    # ingest
    "ingest_usage": _ingested(ingest.ingest),
    "ingest_stream": _ingested(lambda raw: ingest.ingest(raw, skip_streaming=False)),
    "manual_calls": lambda s, d: rounded(ingest.manual_calls(views.logged(s, d)), 6),
    "ingest_lenient": _ingested(ingest.ingest_lenient),
    "stream_ingest": _stream_ingest,
    "stream_totals": _stream_totals,
    "stream_buckets": lambda s, d: _live(s, d, lambda u: live.live_buckets(u, 15)),
    "stream_buckets_7": lambda s, d: _live(s, d, lambda u: live.live_buckets(u, 7)),
    "stream_sizes": lambda s, d: _live(s, d, live.live_sizes),
    "ingest_stats": lambda s, d: ingest.ingest_stats(views.raw(s, d)).fillna(0, ["project_id"]),
    "ingest_counts": _ingest_counts,
    # forecast
    "adaptive_buckets": _users(lambda u, p, h: series.adaptive_buckets(u)),
    "series_choice": _choice(lambda c: c.select("project_id", "use_buckets", "n", "active_days", "remaining_days", "horizon", "buckets_per_day", "data_granularity", "actual_spend", "total_tokens")),
    "ema_forecast": _choice(smoothing.ema),
    "ses_fixed": _choice(lambda c: smoothing.ses_fixed(c).select("project_id", "level0", "level", "sse", "sae")),
    "ses_opt": _choice(lambda c: smoothing.ses_optimal(c)),
    "damped_trend": _choice(lambda c: smoothing.damped_trend(c)),
    "linear_forecast": _choice(lambda c: smoothing.linear(c)),
    "ensemble": _users(_ensemble),
    "intervals": _users(lambda u, p, h: fc.core(u, p).select("project_id", *[F.col(f"prediction_interval_{z}.{s}").alias(f"pi{z}_{s}") for z in ("80", "95") for s in ("lower", "upper")])),
    "accuracy": _core("mase", "mae_dollars", "beats_naive"),
    "drift": _core("smoothed_burn_ratio", "drift_status"),
    "confidence": _core("active_days", "confidence"),
    "model_breakdown": _users(lambda u, p, h: fc.model_breakdown(fc.core(u, p), u)),
    "stability": _users(lambda u, p, h: fc.stability(fc.core(u, p), h).select("project_id", "stability", "stability_label", "iteration")),
    "forecast": _record(lambda r, p: flat(r)),
    "forecast_rows": _record(lambda r, p: fc.as_history(r)),
    "forecast_selected": _users(lambda u, p, h: fc.as_history(fc.for_projects(u, p, h, p.filter(F.col("project_id") % 3 == 0).select("project_id")))),
    "forecast_saved": _users(_save_run),
    "forecast_long": _record(lambda r, p: reports.forecast_long(r)),
    "backtest": _users(lambda u, p, h: fc.backtest(u, p, CUTS)),
    # reports
    "status": _record(lambda r, p: reports.status(r)),
    "status_brief": _record(lambda r, p: reports.status(r, brief=True)),
    "forecast_json": _record(_document),
    "project_status": _users(lambda u, p, h: reports.project_status(u, p)),
    "budget_status": _record(reports.budget_status),
    # suggestions
    "task_class": _usage(lambda u: agg.model_profile(u).select("project_id", "model", optimize.task_class(F.col("avg_in"), F.col("avg_out")).alias("task"))),
    "optimize": _usage(optimize.suggestions),
    "optimize_totals": _usage(lambda u: optimize.total_savings(optimize.suggestions(u))),
    # scope
    "scope_ext_counts": lambda s, d: scope.extension_counts(views.files(s, d)),
    "scope_baseline": lambda s, d: scope.baseline(views.files(s, d)),
    "baseline_budget": lambda s, d: rounded(scope.baseline_budget(scope.as_projects(scope.baseline(views.files(s, d)), budget=20.0), 20.0)),
}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL


def ENTRY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["forecast"](spark, sf_dir)
