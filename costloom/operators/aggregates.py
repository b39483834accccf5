"""Aggregates of usage rows by project, day, minute bucket and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SHORT_OUTPUT = 200
_tokens = lambda: F.sum(F.col("tokens_in") + F.col("tokens_out"))


def daily_costs(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project_id", F.to_date("timestamp").alias("day")).agg(F.sum("cost_usd").alias("cost"), _tokens().alias("total_tokens"))


def bucket_label(ts: Column, minutes: int | Column) -> Column:
    """Start of a bucket that is anchored at the hour."""
    start = F.floor(F.minute(ts) / minutes) * minutes
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:"), F.lpad(start.cast("int").cast("string"), 2, "0"))


def bucketed_costs(usage: DataFrame, minutes: int = 15) -> DataFrame:
    if minutes < 1:
        raise ValueError("a bucket has one minute at least")
    return usage.groupBy("project_id", bucket_label(F.col("timestamp"), minutes).alias("bucket")).agg(
        F.sum("cost_usd").alias("cost"), _tokens().alias("total_tokens")
    )


def active_days(usage: DataFrame) -> DataFrame:
    """Distinct days with calls; days that cost nothing count."""
    return usage.groupBy("project_id").agg(F.count_distinct(F.to_date("timestamp")).alias("active_days"))


def project_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(_tokens(), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend")
    )


def model_costs(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project_id", "model").agg(F.sum("cost_usd").alias("cost"))


def model_tokens(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project_id", "model").agg(F.coalesce(_tokens(), F.lit(0)).alias("total_tokens"))


def model_profile(usage: DataFrame) -> DataFrame:
    """Calls, cost, mean tokens and the short-output part of each project and model, in one pass."""
    short = F.col("tokens_out") < SHORT_OUTPUT
    return usage.groupBy("project_id", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("cost_usd").alias("total_cost"),
        F.coalesce(F.avg("tokens_in"), F.lit(0.0)).alias("avg_in"),
        F.coalesce(F.avg("tokens_out"), F.lit(0.0)).alias("avg_out"),
        F.count_if(short).alias("short_calls"),
        F.coalesce(F.sum(F.when(short, F.col("cost_usd"))), F.lit(0.0)).alias("short_cost"),
    )


def session_summary(usage: DataFrame) -> DataFrame:
    """Totals of each project (level 'project', model null) and of each of its models (level 'model', null ones too)."""
    grouped = usage.groupingSets([["project_id"], ["project_id", "model"]], "project_id", "model")
    level = F.when(F.grouping("model") == 1, "project").otherwise("model").alias("level")
    return grouped.agg(level, F.sum("cost_usd").alias("cost"), _tokens().alias("tokens"), F.count(F.lit(1)).alias("calls"))


def active(series: DataFrame) -> DataFrame:
    return series.filter(F.col("cost") > 0)


def last_days(daily: DataFrame, n: int = 14) -> DataFrame:
    """The last n days with each day's share of the largest of all days."""
    by = W.partitionBy("project_id")
    ranked = daily.withColumn("rank", F.row_number().over(by.orderBy(F.desc("day"))))
    top = daily.groupBy("project_id").agg(F.max("cost").alias("top"))
    kept = ranked.filter(F.col("rank") <= n).join(top, "project_id")
    return kept.select("project_id", "day", "cost", "rank", F.when(F.col("top") > 0, F.col("cost") / F.col("top")).otherwise(0.0).alias("ratio"))


def last_runs(history: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("project_id").orderBy(F.desc("iteration"))
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def convergence(history: DataFrame, n: int = 5) -> DataFrame:
    """The last n runs against the largest of them, for projects with two at least."""
    by = W.partitionBy("project_id")
    runs = last_runs(history, n).withColumn("top", F.max("projected_total").over(by)).withColumn("runs", F.count(F.lit(1)).over(by))
    ratio = F.when(F.col("top") > 0, F.col("projected_total") / F.col("top")).otherwise(0.0)
    return runs.filter("runs >= 2").select("project_id", "iteration", "projected_total", ratio.alias("ratio"))
