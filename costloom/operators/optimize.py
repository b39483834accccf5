"""Model-switch suggestions: one pass over usage, then one branch for each project and model.

The branches are tried in order and the first that applies takes the model, whether or not it yields a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costloom.functions import dims, pricing
from costloom.operators.aggregates import model_profile

HEAVY, LIGHT = "Tier 1 (Heavy)", "Tier 2 (Standard)"
LEAST_SAVING = 0.1


def task_class(avg_in: Column, avg_out: Column) -> Column:
    return F.when((avg_in > 20000) | (avg_out > 800), "Heavy").when((avg_in < 5000) & (avg_out < 200), "Light").otherwise("Standard")


def _alternatives() -> tuple[dict, tuple]:
    """First Tier 2 model of each provider; the Tier 1 model of least output price (the first of equal ones) as (price, model)."""
    second: dict[str, str] = {}
    for m in dims.TIERS[LIGHT].split():
        second.setdefault(pricing.provider_name(m), m)
    return second, min(((dims.OUTPUT_PRICE[m], m) for m in dims.TIERS[HEAVY].split() if m in dims.OUTPUT_PRICE), key=lambda x: x[0])


def suggestions(usage: DataFrame) -> DataFrame:
    """One aggregate; the dimensions are literal maps."""
    m = F.col("model")
    x = pricing.with_tier(model_profile(usage)).withColumn("task", task_class(F.col("avg_in"), F.col("avg_out")))
    second, (cheapest_out, cheapest) = _alternatives()
    for name, rows in (("always", dims.ALWAYS_SWITCH), ("short", dims.SHORT_OUTPUT_SWITCH)):
        x = x.withColumns({f"{name}_alt": dims.lookup([(k, alt) for k, alt, _ in rows], m), f"{name}_pct": dims.lookup([(k, pct) for k, _, pct in rows], m)})
    x = x.withColumn("light_alt", dims.lookup(second.items(), pricing.provider_of(m))).withColumn("model_out", dims.lookup(dims.OUTPUT_PRICE.items(), m))
    # the cheapest one is no alternative to itself, and then no other costs less
    x = x.withColumn("lateral_alt", F.when((m != cheapest) & (F.lit(cheapest_out) < F.coalesce("model_out", F.lit(float("inf")))), cheapest))
    heavy = F.col("tier") == HEAVY
    branch = (
        F.when(F.col("always_alt").isNotNull(), "always").when((F.col("task") == "Light") & heavy, "light")
        .when((F.col("task") == "Heavy") & heavy, "lateral").when(F.col("short_alt").isNotNull(), "short")
    )
    x = x.withColumn("branch", branch).filter("branch is not null")
    alt = F.when(F.col("branch") == "always", F.col("always_alt")).when(F.col("branch") == "light", F.col("light_alt"))
    alt = alt.when(F.col("branch") == "lateral", F.col("lateral_alt")).otherwise(F.col("short_alt"))
    x = x.withColumn("alternative", alt).filter("alternative is not null").withColumn("alternative_out", dims.lookup(dims.OUTPUT_PRICE.items(), F.col("alternative")))
    by_price = F.when(F.col("model_out") > 0, 1 - F.coalesce("alternative_out", F.lit(0.0)) / F.col("model_out")).otherwise(0.0)
    pct = F.when(F.col("branch") == "always", F.col("always_pct")).when(F.col("branch") == "short", F.col("short_pct")).otherwise(by_price)
    x = x.withColumn("pct", pct).filter("(branch != 'lateral' or pct > 0.1) and (branch != 'short' or short_calls > 0)")
    base = F.when(F.col("branch") == "short", F.col("short_cost")).otherwise(F.col("total_cost"))
    calls = F.col("calls").cast("string")
    reason = (
        F.when(F.col("branch") == "always", F.concat(F.lit("Newer/cheaper model ("), calls, F.lit(" calls)")))
        .when(F.col("branch") == "light", F.concat(F.lit("Short outputs (avg "), F.bround("avg_out", 0).cast("long").cast("string"), F.lit(" tok) safe for Tier 2")))
        .when(F.col("branch") == "lateral", F.concat(F.lit("Lateral Tier 1 move ("), calls, F.lit(" heavy calls)")))
        .otherwise(F.concat(F.col("short_calls").cast("string"), F.lit("/"), calls, F.lit(" calls have short outputs")))
    )
    return x.select("project_id", "model", "alternative", "task", reason.alias("reason"), (base * F.greatest(F.lit(0.0), F.col("pct"))).alias("savings"))


def total_savings(found: DataFrame) -> DataFrame:
    return found.groupBy("project_id").agg(F.count(F.lit(1)).alias("suggestions"), F.sum("savings").alias("savings"))
