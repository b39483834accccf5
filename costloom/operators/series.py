"""The series a forecast runs on: adaptive buckets, the choice between buckets and days, horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from costloom.operators.aggregates import active, bucket_label

SIZES = (15, 5, 1)
LEAST_POINTS = 3


def by_minute(usage: DataFrame) -> DataFrame:
    """Calls summed by minute: days and all buckets are rolled up from it."""
    return usage.groupBy("project_id", F.date_trunc("minute", "timestamp").alias("at")).agg(F.sum("cost_usd").alias("cost"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"))


def _adaptive(fine: DataFrame) -> DataFrame:
    sized = fine.select("*", F.explode(F.array(*map(F.lit, SIZES))).alias("size"))
    rolled = sized.groupBy("project_id", "size", bucket_label(F.col("at"), F.col("size")).alias("bucket")).agg(F.sum("cost").alias("cost"), F.sum("total_tokens").alias("total_tokens"))
    enough = F.count_if(F.col("cost") > 0).over(W.partitionBy("project_id", "size")) >= LEAST_POINTS
    best = F.coalesce(F.max(F.when(F.col("enough"), F.col("size"))).over(W.partitionBy("project_id")), F.lit(1))
    # one shuffle by project serves both windows
    marked = rolled.repartition("project_id").withColumn("enough", enough).withColumn("minutes", best)
    return marked.filter("size = minutes").select("project_id", "minutes", "bucket", "cost", "total_tokens")


def adaptive_buckets(usage: DataFrame) -> DataFrame:
    """Buckets of the coarsest of 15, 5 and 1 minutes that has three active ones, else of one minute."""
    return _adaptive(by_minute(usage))


def series_choice(usage: DataFrame, projects: DataFrame) -> DataFrame:
    """A row per project: which series is used, its points in order, horizon and rates.

    A project's array is bounded by the calendar, not by its calls. Projects without usage have empty series.
    """
    fine = by_minute(usage)
    daily = fine.groupBy("project_id", F.to_date("at").alias("day")).agg(F.sum("cost").alias("cost"), F.sum("total_tokens").alias("total_tokens"))
    ordered = lambda points: F.transform(F.array_sort(F.collect_list(points)), lambda s: s["cost"])
    paid = F.when(F.col("cost") > 0, F.struct("day", "cost"))
    days = daily.groupBy("project_id").agg(F.sum("total_tokens").alias("total_tokens"), ordered(paid).alias("daily"), F.sum(F.when(F.col("cost") > 0, F.col("cost"))).alias("actual_spend"))
    buckets = active(_adaptive(fine)).groupBy("project_id").agg(ordered(F.struct("bucket", "cost")).alias("buckets"), F.max("minutes").alias("minutes"))
    x = projects.join(days, "project_id", "left").join(buckets, "project_id", "left")
    empty = F.array().cast("array<double>")
    x = x.withColumn("daily", F.coalesce("daily", empty)).withColumn("buckets", F.coalesce("buckets", empty))
    x = x.withColumn("actual_spend", F.coalesce("actual_spend", F.lit(0.0))).withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0)))
    n_days, n_buckets = F.size("daily"), F.size("buckets")
    x = x.withColumn("active_days", n_days).withColumn("use_buckets", (n_buckets >= LEAST_POINTS) & (n_buckets > n_days))
    x = x.withColumn("series", F.when(F.col("use_buckets"), F.col("buckets")).otherwise(F.col("daily")))
    x = x.withColumn("n", F.size("series")).withColumn("remaining_days", F.greatest(F.lit(1), F.col("baseline_total_days") - n_days))
    x = x.withColumn("buckets_per_day", F.when(F.col("use_buckets"), n_buckets / F.greatest(F.lit(1), n_days)).otherwise(1.0))
    x = x.withColumn("horizon", F.when(F.col("use_buckets"), n_buckets).otherwise(F.col("remaining_days")))
    x = x.withColumn("data_granularity", F.when(F.col("use_buckets"), F.concat(F.col("minutes").cast("string"), F.lit("min_buckets"))).otherwise("daily"))
    x = x.withColumn("base", F.when(F.col("baseline_daily_cost") > 0, F.col("baseline_daily_cost")).otherwise(1.0))
    return x.drop("buckets", "minutes")

