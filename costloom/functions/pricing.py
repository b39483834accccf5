"""Model resolution, cost, tier, provider and token estimates as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from costloom.functions import dims

# The date suffix, the default models; below, the providers by name.
DATE_SUFFIX = r"-\d{4}(-\d{2}-\d{2}|\d{4})?$"
DEFAULT_MODELS = ["gpt-4o", "gpt-4o-mini", "claude-3-5-sonnet-latest", "claude-3-5-haiku-latest", "gemini-2.5-pro", "gemini-2.5-flash"]
PROVIDERS = [  # provider, what its models' names start with, what they contain; the first that applies
    ("google", (), ("text-embedding-004",)),
    ("openai", ("gpt-", "o1", "o3"), ("text-embedding",)),
    ("anthropic", ("claude",), ()),
    ("google", ("gemini",), ()),
    ("mistral", ("mistral", "codestral", "open-mistral"), ()),
    ("deepseek", ("deepseek",), ()),
    ("xai", ("grok",), ()),
    ("meta", ("llama",), ()),
    ("cohere", ("command",), ()),
]


def stripped(model: Column) -> Column:
    return F.regexp_replace(model, DATE_SUFFIX, "")


def listed_part(model: Column) -> Column:
    """The longest listed name that the name without its date is, or begins with up to a `-`; empty where there is none."""
    names = sorted((re.escape(m) for m, *_ in dims.PRICE_ROWS), key=len, reverse=True)
    return F.regexp_extract(stripped(model), f"^({'|'.join(names)})(?=-|$)", 1)


def resolve_models(models: DataFrame) -> DataFrame:
    """models: `model` -> model, priced_as, input, output (null where none resolves).

    Candidates in order: the name, the name without its date, then that with one `-part` less each time.
    """
    listed = dims.lookup(dims.BOOK, F.col("model")).isNotNull()
    x = models.select("model", F.when(listed, F.col("model")).otherwise(F.nullif(listed_part(F.col("model")), F.lit(""))).alias("priced_as"))
    return x.withColumn("__p", dims.lookup(dims.BOOK, F.col("priced_as"))).select("model", "priced_as", F.col("__p")[0].alias("input"), F.col("__p")[1].alias("output"))


def cost_of(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def price_of(model: Column) -> Column:
    """array<input, output> of a name, the default where none resolves: generated code, listed names take one lookup."""
    return F.coalesce(dims.lookup(dims.BOOK, model), dims.lookup(dims.BOOK, listed_part(model)), F.array(*[F.lit(float(d)) for d in dims.DEFAULT_PRICE]))


def with_cost(calls: DataFrame, name: str = "cost_usd") -> DataFrame:
    """Adds the cost; names that don't resolve cost the default price. An expression: no join, no shuffle."""
    return calls.withColumn("__p", price_of(F.col("model"))).withColumn(name, cost_of(F.col("tokens_in"), F.col("tokens_out"), F.col("__p")[0], F.col("__p")[1])).drop("__p")


def unknown_models(calls: DataFrame) -> DataFrame:
    counts = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    unknown = dims.lookup(dims.BOOK, F.col("model")).isNull() & (listed_part(F.col("model")) == "")
    return counts.filter(unknown)


def tier_of(model: Column) -> Column:
    """By name, then by the name without its date, else Unknown (no shorter names are tried)."""
    return F.coalesce(dims.lookup(dims.TIER_OF, model), dims.lookup(dims.TIER_OF, stripped(model)), F.lit("Unknown"))


def with_tier(df: DataFrame, model: str = "model") -> DataFrame:
    return df.withColumn("tier", tier_of(F.col(model)))


def tier_number(tier: Column) -> Column:
    return F.when(tier == "Unknown", "?").otherwise(F.regexp_extract(tier, r"Tier (\d)", 1))


def provider_of(model: Column) -> Column:
    m = F.lower(model)
    out = F.when(F.lit(False), "")
    for provider, starts, parts in PROVIDERS:
        out = out.when(reduce(or_, [m.startswith(x) for x in starts] + [m.contains(x) for x in parts]), provider)
    return out.otherwise("unknown")


def provider_name(model: str) -> str:
    """provider_of for a name at hand."""
    m = model.lower()
    return next((p for p, starts, parts in PROVIDERS if m.startswith(starts) or any(x in m for x in parts)), "unknown")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def catalog(spark, tier: str | None = None) -> DataFrame:
    """Price list by provider and input price, with tiers; `tier` keeps one tier number."""
    out = with_tier(dims.prices(spark).select(F.col("price_model").alias("model"), "input", "output"))
    out = out.withColumn("provider", provider_of(F.col("model"))).withColumn("tier_num", tier_number(F.col("tier")))
    if tier is not None:
        out = out.filter(F.col("tier_num") == str(tier))
    return out.orderBy("provider", "input", "model")


def calc(prompts: DataFrame, models: list[str] | None = None, output_tokens: int = 500, calls: int = 1) -> DataFrame:
    """prompt_id, prompt -> a row per prompt and model with its cost. The model list is the small side."""
    spark = prompts.sparkSession
    named = spark.createDataFrame([(m.strip(),) for m in models or DEFAULT_MODELS if m.strip()], "model string")
    priced = with_tier(resolve_models(named)).select(
        "model", "tier", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(("input", "output"), dims.DEFAULT_PRICE)]
    )
    rows = prompts.select("prompt_id", token_estimate(F.col("prompt")).alias("input_tokens")).crossJoin(F.broadcast(priced))
    rows = rows.withColumn("output_tokens", F.lit(output_tokens).cast("long"))
    rows = rows.withColumn("cost_per_call", cost_of(F.col("input_tokens"), F.col("output_tokens"), F.col("input"), F.col("output")))
    return rows.select("prompt_id", "model", "input_tokens", "output_tokens", "cost_per_call", (F.col("cost_per_call") * calls).alias("cost_total"), "tier")


def calc_extremes(matrix: DataFrame) -> DataFrame:
    """Cheapest and dearest model of each prompt and their ratio (two models at least, dearest above 0)."""
    by = lambda c, sign: F.struct((F.col(c) * sign).alias("k"), "model")
    out = matrix.groupBy("prompt_id").agg(
        F.min(by("cost_per_call", 1)).alias("lo"), F.min(by("cost_per_call", -1)).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    out = out.filter((F.col("n") >= 2) & (F.col("hi.k") < 0))
    return out.select("prompt_id", F.col("lo.model").alias("cheapest"), F.col("hi.model").alias("dearest"), F.try_divide(-F.col("hi.k"), F.col("lo.k")).alias("ratio"))
