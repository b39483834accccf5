"""Raw API responses -> priced usage rows; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from costloom.functions import pricing
from costloom.sources import tables

OUT = ["project_id", "timestamp", "model", "provider", "tokens_in", "tokens_out", "cost_usd", "metadata", "source"]
STATUSES = ("tracked", "skipped_streaming", "ignored", "error")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _whole(v: Column, kind: Column) -> Column:
    """A number as a whole one (cut, not rounded), a string of digits as that number, else null. kind: of v."""
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, "$", "double").cast("long"))
        .when((kind == "STRING") & text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).cast("long"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long"))
    )


KEYS = ("prompt_tokens", "completion_tokens", "input_tokens", "output_tokens")


def with_fields(raw: DataFrame) -> DataFrame:
    """Adds __f: all that is read from a body, in one struct.

    Each step is a generator of one element: no later filter or projection goes below it, so the text is parsed once
    a row and each value is read and tested once, whatever refers to it.
    """

    def step(df: DataFrame, made: Column, name: str) -> DataFrame:
        return df.select(*raw.columns, F.explode(F.array(made)).alias(name))

    v, r = F.col("__v"), lambda name: F.col(f"__r.{name}")
    values = {"usage": _at(v, "$.usage")} | {k: _at(v, f"$.usage.{k}") for k in KEYS} | {k: _at(v, f"$.{k}") for k in ("model", "id")}
    choices = F.try_variant_get(v, "$.choices", "array<variant>")
    named = F.filter(F.transform(choices, lambda c: F.try_variant_get(c, "$.message.model", "string")), lambda m: m.isNotNull())
    read = F.struct(
        v.isNotNull().alias("read"), _kind(v).alias("root"), F.get(named, F.lit(0)).alias("choice"),
        *[x.alias(k) for k, x in values.items()], *[_kind(x).alias(f"kind_{k}") for k, x in values.items()],
    )
    text = lambda k: F.try_variant_get(r(k), "$", "string")
    fields = F.struct(
        r("read").alias("read"), r("root").alias("root"), r("kind_usage").alias("usage"), r("choice").alias("choice"),
        *[r(k).isNotNull().alias(f"has_{k}") for k in KEYS], *[_whole(r(k), r(f"kind_{k}")).alias(k) for k in KEYS],
        *[F.when(r(f"kind_{k}") == "STRING", text(k)).alias(k) for k in ("model", "id")], *[text(k).alias(f"any_{k}") for k in ("model", "id")],
    )
    parsed = step(raw, F.try_parse_json(F.when(F.col("body") != "", F.col("body"))), "__v")
    return step(step(parsed, read, "__r"), fields, "__f")


def classify(raw: DataFrame, skip_streaming: bool = True) -> DataFrame:
    """Adds status (tracked, skipped_streaming, ignored, error), model, tokens_in, tokens_out."""
    f = lambda name: F.col(f"__f.{name}")
    x = with_fields(raw)
    first, second = f("has_prompt_tokens") & f("has_completion_tokens"), f("has_input_tokens") & f("has_output_tokens")
    x = x.withColumn("tokens_in", F.when(first, f("prompt_tokens")).when(second, f("input_tokens")))
    x = x.withColumn("tokens_out", F.when(first, f("completion_tokens")).when(second, f("output_tokens")))
    x = x.withColumn("model", F.coalesce(f("model"), f("id"), f("choice"), F.lit("unknown")))
    streaming = F.coalesce(F.col("content_type"), F.lit("")).startswith("text/event-stream")
    status = F.when(streaming, "skipped_streaming") if skip_streaming else F.when(F.lit(False), "")
    status = (
        status.when(~f("read"), "ignored")
        .when(f("root") != "OBJECT", "error")
        .when(f("usage").isNull() | (f("usage") != "OBJECT") | ~(first | second), "ignored")
        .when(F.col("tokens_in").isNull() | F.col("tokens_out").isNull(), "error")
        .when(F.col("project_id").isNull(), "ignored")
        .otherwise("tracked")
    )
    return x.withColumn("status", status).drop("__f")


def priced(calls: DataFrame) -> DataFrame:
    """project_id, timestamp, model, tokens_in, tokens_out -> usage rows. Keeps to expressions that streams allow."""
    keep = [c if c in calls.columns else F.lit(None).cast("string").alias(c) for c in ("metadata",)]
    out = pricing.with_cost(calls)
    source = F.coalesce(F.col("source"), F.lit("api")) if "source" in calls.columns else F.lit("api")
    return out.select("project_id", "timestamp", "model", pricing.provider_of(F.col("model")).alias("provider"), "tokens_in", "tokens_out", "cost_usd", *keep, source.alias("source")).select(*OUT)


def ingest(raw: DataFrame, skip_streaming: bool = True, observation: Observation | str | None = None) -> DataFrame:
    """Usage rows of the tracked responses. An observation counts all responses by status as they pass, whatever job reads the rows."""
    x = classify(raw, skip_streaming)
    if observation is not None:
        x = x.observe(observation, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return priced(x.filter("status = 'tracked'").withColumn("timestamp", F.col("received_at")))


def append_ingested(raw: DataFrame, path: str, skip_streaming: bool = True) -> dict[str, int]:
    """Appends the usage rows to a table and returns the counts by status: one job, each body is parsed once."""
    observation = Observation()
    tables.append_usage(ingest(raw, skip_streaming, observation).withColumn("id", F.lit(None).cast("long")), path)
    return observation.get


def ingest_lenient(raw: DataFrame) -> DataFrame:
    """Each field falls back on its own: prompt_tokens, input_tokens, 0; model, id, unknown. No content-type test."""
    f = lambda name: F.col(f"__f.{name}")
    x = with_fields(raw).filter((f("root") == "OBJECT") & (f("usage") == "OBJECT") & F.col("project_id").isNotNull())
    either = lambda a, b: F.when(f(f"has_{a}"), f(a)).when(f(f"has_{b}"), f(b)).otherwise(0)
    x = x.withColumn("tokens_in", either("prompt_tokens", "input_tokens")).withColumn("tokens_out", either("completion_tokens", "output_tokens"))
    x = x.withColumn("model", F.coalesce(f("any_model"), f("any_id"), F.lit("unknown"))).filter("tokens_in is not null and tokens_out is not null").drop("__f")
    return priced(x.withColumn("timestamp", F.col("received_at")))


def manual_calls(calls: DataFrame) -> DataFrame:
    """Hand-logged calls: metadata (a map) becomes JSON text, an empty one null; a given provider is ignored."""
    text = F.when(F.size("metadata") > 0, F.to_json("metadata"))
    return priced(calls.withColumn("metadata", text).drop("provider"))


def ingest_stats(raw: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return classify(raw).groupBy("project_id").agg(*map(count, STATUSES))
