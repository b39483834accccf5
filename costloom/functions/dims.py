"""Price, tier and switch dimensions: rows, literal maps for expressions, and the price list as a small DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# List prices in USD per million tokens (model, input, output).
PRICES = """
gpt-4o 2.50 10.00
gpt-4o-2024-11-20 2.50 10.00
gpt-4o-2024-08-06 2.50 10.00
gpt-4o-2024-05-13 5.00 15.00
gpt-4o-mini 0.15 0.60
gpt-4o-mini-2024-07-18 0.15 0.60
gpt-4-turbo 10.00 30.00
gpt-4-turbo-2024-04-09 10.00 30.00
gpt-4-turbo-preview 10.00 30.00
gpt-4-1106-preview 10.00 30.00
gpt-4-0125-preview 10.00 30.00
gpt-4 30.00 60.00
gpt-4-0613 30.00 60.00
gpt-4-32k 60.00 120.00
gpt-4-32k-0613 60.00 120.00
gpt-3.5-turbo 0.50 1.50
gpt-3.5-turbo-0125 0.50 1.50
gpt-3.5-turbo-1106 1.00 2.00
gpt-3.5-turbo-instruct 1.50 2.00
o1 15.00 60.00
o1-2024-12-17 15.00 60.00
o1-preview 15.00 60.00
o1-preview-2024-09-12 15.00 60.00
o1-mini 3.00 12.00
o1-mini-2024-09-12 3.00 12.00
o3-mini 1.10 4.40
o3-mini-2025-01-31 1.10 4.40
text-embedding-3-small 0.02 0.00
text-embedding-3-large 0.13 0.00
text-embedding-ada-002 0.10 0.00
claude-3-5-sonnet-20241022 3.00 15.00
claude-3-5-sonnet-latest 3.00 15.00
claude-3-5-sonnet-20240620 3.00 15.00
claude-3-5-haiku-20241022 0.80 4.00
claude-3-5-haiku-latest 0.80 4.00
claude-3-opus-20240229 15.00 75.00
claude-3-opus-latest 15.00 75.00
claude-3-sonnet-20240229 3.00 15.00
claude-3-haiku-20240307 0.25 1.25
claude-2.1 8.00 24.00
claude-2.0 8.00 24.00
claude-instant-1.2 0.80 2.40
gemini-2.0-flash 0.10 0.40
gemini-2.0-flash-001 0.10 0.40
gemini-1.5-pro 1.25 5.00
gemini-1.5-pro-002 1.25 5.00
gemini-1.5-pro-001 1.25 5.00
gemini-1.5-flash 0.075 0.30
gemini-1.5-flash-002 0.075 0.30
gemini-1.5-flash-001 0.075 0.30
gemini-1.5-flash-8b 0.0375 0.15
gemini-1.5-flash-8b-001 0.0375 0.15
gemini-1.0-pro 0.50 1.50
gemini-pro 0.50 1.50
text-embedding-004 0.00 0.00
mistral-large-latest 2.00 6.00
mistral-medium-latest 2.70 8.10
mistral-small-latest 0.20 0.60
open-mistral-nemo 0.15 0.15
codestral-latest 0.20 0.60
gpt-4.5-preview 75.00 150.00
o3 10.00 40.00
o3-2025-04-16 10.00 40.00
o3-pro 20.00 80.00
gpt-4o-audio-preview 2.50 10.00
gpt-4o-realtime 5.00 20.00
claude-sonnet-4-20250514 3.00 15.00
claude-opus-4-20250514 15.00 75.00
claude-haiku-4-5-20251001 0.80 4.00
gemini-2.5-pro 1.25 10.00
gemini-2.5-pro-preview-05-06 1.25 10.00
gemini-2.5-flash 0.15 0.60
gemini-2.5-flash-preview-04-17 0.15 0.60
deepseek-chat 0.27 1.10
deepseek-reasoner 0.55 2.19
grok-2 2.00 10.00
grok-2-mini 0.30 0.50
grok-3 3.00 15.00
llama-3.1-405b 3.00 3.00
llama-3.1-70b 0.80 0.80
llama-3.3-70b 0.80 0.80
command-r-plus 2.50 10.00
command-r 0.15 0.60
"""
DEFAULT_PRICE = (5.0, 15.0)  # fixed values: for models that don't resolve

# Capability tiers; the order inside a tier decides ties.
TIERS = {
    "Tier 1 (Heavy)": "gpt-4o gpt-4-turbo gpt-4 gpt-4.5-preview o1 o1-preview o3 o3-pro claude-3-5-sonnet-latest claude-3-5-sonnet-20241022 claude-3-5-sonnet-20240620 claude-3-opus-20240229 claude-3-opus-latest claude-sonnet-4-20250514 claude-opus-4-20250514 gemini-2.5-pro gemini-1.5-pro grok-3 mistral-large-latest llama-3.1-405b deepseek-reasoner",
    "Tier 2 (Standard)": "gpt-4o-mini o1-mini o3-mini claude-3-5-haiku-latest claude-3-5-haiku-20241022 claude-haiku-4-5-20251001 claude-3-sonnet-20240229 gemini-2.5-flash gemini-2.0-flash gemini-1.5-flash grok-2 mistral-medium-latest llama-3.1-70b llama-3.3-70b deepseek-chat command-r-plus",
    "Tier 3 (Economy)": "gpt-3.5-turbo gpt-3.5-turbo-instruct claude-3-haiku-20240307 claude-2.1 claude-2.0 claude-instant-1.2 gemini-1.5-flash-8b gemini-1.0-pro gemini-pro grok-2-mini mistral-small-latest open-mistral-nemo codestral-latest command-r",
}
# Model, alternative, share saved.
ALWAYS_SWITCH = [
    ("gpt-4-turbo", "gpt-4o", 0.67),
    ("gpt-4", "gpt-4o", 0.92),
    ("claude-3-opus-20240229", "claude-3-5-sonnet-latest", 0.80),
    ("claude-3-opus-latest", "claude-3-5-sonnet-latest", 0.80),
]
SHORT_OUTPUT_SWITCH = [
    ("gpt-4o", "gpt-4o-mini", 0.94),
    ("claude-3-5-sonnet-20241022", "claude-3-5-haiku-latest", 0.73),
    ("claude-3-5-sonnet-latest", "claude-3-5-haiku-latest", 0.73),
]

PRICE_ROWS = [(m, float(i), float(o)) for m, i, o in (x.split() for x in PRICES.strip().splitlines())]
TIER_ROWS = [(tier, m, k) for tier, models in TIERS.items() for k, m in enumerate(models.split())]


BOOK = [(m, (i, o)) for m, i, o in PRICE_ROWS]
OUTPUT_PRICE = {m: o for m, _, o in PRICE_ROWS}
TIER_OF = [(m, tier) for tier, m, _ in TIER_ROWS]


@cache
def _sql(rows: tuple) -> str:
    """A map as SQL text, made once: parsing it is one call, and the optimizer folds it into a literal."""

    def shown(v) -> str:
        if isinstance(v, tuple):
            return f"array({', '.join(map(shown, v))})"
        return f"{v}D" if isinstance(v, float) else "'" + v.replace("'", "\\'") + "'"

    return f"map({', '.join(f'{shown(k)}, {shown(v)}' for k, v in rows)})"


def lookup(rows: Iterable[tuple], key: Column) -> Column:
    """The value of a key in (key, value) rows, null where there is none: generated code, no join. Values: text, double or tuples of them."""
    return F.try_element_at(F.expr(_sql(tuple(rows))), key)


def prices(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PRICE_ROWS, "price_model string, input double, output double"))
