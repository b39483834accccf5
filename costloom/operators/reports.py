"""Status, budget and long-form reports from forecast records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costloom.operators.aggregates import active_days, project_totals

LEVELS = ["low", "medium-low", "medium", "high", "very-high"]


def status(record: DataFrame, brief: bool = False) -> DataFrame:
    """A row per project; the brief form has no tokens. Never saved."""
    spent, projected = F.col("actual_spend"), F.col("projected_total")
    out = record.select(
        "project_id", "project_name", F.col("total_tokens").alias("tokens"), spent.alias("spent"), projected.alias("projected"), F.col("active_days").alias("day"), "total_days",
        F.col("drift_status").alias("drift"),
        F.when(projected > 0, spent / projected * 100).otherwise(0.0).alias("progress"),
        ((spent == 0) & (F.col("total_tokens") > 0)).alias("subscription"),
        F.array_position(F.array(*map(F.lit, LEVELS)), F.col("confidence")).alias("confidence_level"),
    )
    return out.drop("tokens") if brief else out


def project_status(usage: DataFrame, projects: DataFrame) -> DataFrame:
    """Baselines beside what is used: all days with calls count."""
    out = projects.join(active_days(usage), "project_id", "left").join(project_totals(usage), "project_id", "left")
    return out.select(
        "project_id", "name", "baseline_daily_cost", "baseline_total_days", "baseline_total_cost",
        F.coalesce("active_days", F.lit(0)).alias("active_days"), F.coalesce("spend", F.lit(0.0)).alias("actual_spend"),
    )


def budget_status(record: DataFrame, budgets: DataFrame) -> DataFrame:
    """0: in budget or none set, 1: the projection is over it, 2: the spend is."""
    x = record.select("project_id", "actual_spend", "projected_total").join(budgets.select("project_id", "budget"), "project_id", "left")
    code = F.when(F.col("budget").isNull(), 0).when(F.col("actual_spend") > F.col("budget"), 2).when(F.col("projected_total") > F.col("budget"), 1).otherwise(0)
    return x.select("project_id", "budget", code.alias("code"))


def forecast_long(record: DataFrame) -> DataFrame:
    """metric, value rows to four decimals, and a row for each model."""
    metrics = {
        "actual_spend": "actual_spend", "projected_total": "projected_total", "projected_remaining": "projected_remaining", "remaining_days": "remaining_days",
        "active_days": "active_days", "total_days": "total_days", "smoothed_burn_ratio": "smoothed_burn_ratio",
    }
    flat = record.select("project_id", *[F.col(c).cast("double").alias(k) for k, c in metrics.items()])
    rows = flat.unpivot("project_id", list(metrics), "metric", "value")
    by_model = record.select("project_id", F.explode("model_breakdown").alias("m")).select("project_id", F.concat(F.lit("model:"), "m.model").alias("metric"), F.col("m.projected").alias("value"))
    return rows.unionByName(by_model).withColumn("value", F.round("value", 4))


def as_json(record: DataFrame) -> DataFrame:
    return record.select("project_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
