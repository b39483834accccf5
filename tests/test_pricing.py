import pytest
from pyspark.sql import functions as F

from costloom.functions import dims, pricing


def costs(spark, rows):
    df = spark.createDataFrame(rows, "model string, tokens_in long, tokens_out long")
    return {(r.model, r.tokens_in): r.cost_usd for r in pricing.with_cost(df).collect()}


def test_costs(spark):
    got = costs(spark, [("gpt-4o", 10**6, 500_000), ("claude-3-5-sonnet-latest", 10**6, 500_000), ("gpt-4o-2024-99-99", 10**6, 500_000), ("unknown-model-xyz", 10**6, 500_000), ("gpt-4o", 0, 0), ("gpt-4o-mini", 10**6, 500_000), ("gpt-4o", 8, 500)])
    want = {("gpt-4o", 10**6): 7.5, ("claude-3-5-sonnet-latest", 10**6): 10.5, ("gpt-4o-2024-99-99", 10**6): 7.5, ("unknown-model-xyz", 10**6): 12.5, ("gpt-4o", 0): 0.0, ("gpt-4o-mini", 10**6): 0.45, ("gpt-4o", 8): 0.00502}
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_resolution(spark):
    df = spark.createDataFrame([(m,) for m in ("gpt-4o", "gpt-4o-20240806", "gpt-4o-mini-foo-bar", "gpt-4-0613", "GPT-4o", "o1-x-2024-01-01", "")], "model string")
    got = {r.model: r.priced_as for r in pricing.resolve_models(df).collect()}
    assert got == {"gpt-4o": "gpt-4o", "gpt-4o-20240806": "gpt-4o", "gpt-4o-mini-foo-bar": "gpt-4o-mini", "gpt-4-0613": "gpt-4-0613", "GPT-4o": None, "o1-x-2024-01-01": "o1", "": None}
    plan = pricing.resolve_models(df)._jdf.queryExecution().toString()
    assert "Join" not in plan  # an expression: it runs in streams as well, and needs no other table


def test_providers_and_tiers(spark):
    names = {"gpt-4o": "openai", "o1": "openai", "claude-3-5-sonnet-latest": "anthropic", "gemini-1.5-pro": "google", "text-embedding-004": "google", "text-embedding-3-small": "openai", "mistral-large-latest": "mistral", "open-mistral-nemo": "mistral", "deepseek-chat": "deepseek", "grok-2": "xai", "llama-3.1-70b": "meta", "command-r": "cohere", "custom-model": "unknown"}
    df = spark.createDataFrame([(m,) for m in names], "model string").withColumn("p", pricing.provider_of(F.col("model")))
    assert {r.model: r.p for r in df.collect()} == names
    tiers = {"gpt-4o": 1, "gpt-4o-mini": 2, "gpt-3.5-turbo": 3, "nonexistent-model": "?", "gpt-4o-2024-08-06": 1, "gpt-4o-mini-x": "?"}
    df = pricing.with_tier(spark.createDataFrame([(m,) for m in tiers], "model string")).withColumn("k", pricing.tier_number(F.col("tier")))
    assert {r.model: r.k for r in df.collect()} == {m: str(k) for m, k in tiers.items()}


def test_dimensions(spark):
    assert len(dims.PRICE_ROWS) == 83 and len({m for m, *_ in dims.PRICE_ROWS}) == 83
    assert [sum(t == x for t, *_ in dims.TIER_ROWS) for x in dims.TIERS] == [21, 16, 14]
    listed = pricing.catalog(spark).collect()
    assert len(listed) == 83 and sum(r.tier == "Unknown" for r in listed) == 19
    assert {r.tier_num for r in pricing.catalog(spark, "2").collect()} == {"2"}


def test_calc(spark):
    df = spark.createDataFrame([(1, "x" * 41), (2, ""), (3, "x" * 400)], "prompt_id long, prompt string")
    rows = pricing.calc(df, calls=3).collect()
    assert len(rows) == 18 and {r.prompt_id: r.input_tokens for r in rows} == {1: 10, 2: 1, 3: 100}
    assert all(r.cost_total == pytest.approx(3 * r.cost_per_call) for r in rows)
    best = {r.prompt_id: r for r in pricing.calc_extremes(pricing.calc(df)).collect()}
    assert best[1].cheapest == "gemini-2.5-flash" and best[1].dearest == "claude-3-5-sonnet-latest" and best[1].ratio > 20
    assert pricing.calc_extremes(pricing.calc(df, ["gpt-4o"])).count() == 0
