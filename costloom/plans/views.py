"""Usage-shaped views that Spark derives from the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from costloom.functions import pricing

NORMAL, HEAVY, LIGHT = (100, 10), (100, 30), (50, 1)  # tokens in for each k, tokens out for each unit of value
MODEL_OF = {  # by event type and number modulo 3: listed, dated, shortened and unknown names of all tiers, in heavy and light use
    "view": [("gpt-4o", NORMAL), ("o1-preview", HEAVY), ("gpt-4.5-preview", LIGHT)],
    "click": [("gpt-4o-mini", NORMAL), ("gemini-2.5-pro-preview-05-06", NORMAL), ("claude-3-5-sonnet-20240620", HEAVY)],
    "purchase": [("claude-3-opus-latest", NORMAL), ("gpt-4-turbo-2024-04-09", NORMAL), ("o3", LIGHT)],
    "signup": [("gpt-4o-2024-99-99", NORMAL), ("claude-sonnet-4-20250514", LIGHT), ("grok-3", HEAVY)],
    "error": [("unknown-model-xyz", NORMAL), ("mistral-large-latest-eu-2024-07-01", HEAVY), ("text-embedding-004", LIGHT)],
}
MODEL_ROWS = [(kind, k, model, *units) for kind, models in MODEL_OF.items() for k, (model, units) in enumerate(models)]

USES = "map(" + ", ".join(f"'{kind}:{k}', named_struct('model', '{m}', 'i', {i}, 'o', {o})" for kind, k, m, i, o in MODEL_ROWS) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls that have no cost yet."""
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(e: DataFrame) -> DataFrame:
    key = lambda kind, k: F.concat(kind, F.lit(":"), k)
    e = e.withColumn("use", F.try_element_at(F.expr(USES), key(F.col("event_type"), (F.col("event_id") % 3).cast("string"))))
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5 + 1).alias("project_id"), "user_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("use.model").alias("model"),
        (F.get_json_object("props", "$.k").cast("long") * F.col("use.i")).alias("tokens_in"), F.floor(F.col("value") * F.col("use.o")).cast("long").alias("tokens_out"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pricing.with_cost(calls(spark, sf_dir))
    return out.withColumns({"provider": pricing.provider_of(F.col("model")), "metadata": F.lit(None).cast("string"), "source": F.lit("api")})


def user_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each user, and one more with the times cut to days; every seventh day costs nothing."""
    u = usage(spark, sf_dir).withColumn("cost_usd", F.when(F.dayofmonth("timestamp") % 7 == 0, 0.0).otherwise(F.col("cost_usd")))
    twice = F.explode(F.array(F.struct(F.col("user_id").alias("project_id"), "timestamp"), F.struct((F.col("user_id") + 1000000).alias("project_id"), F.date_trunc("day", "timestamp").alias("timestamp"))))
    return u.select("id", "model", "tokens_in", "tokens_out", "cost_usd", twice.alias("t")).select("id", "t.project_id", "t.timestamp", "model", "tokens_in", "tokens_out", "cost_usd")


def projects(usage: DataFrame) -> DataFrame:
    """A project row for each project in usage, with baselines that it over- and undershoots."""
    p = F.col("project_id")
    spend = usage.groupBy("project_id").agg(F.sum("cost_usd").alias("spend"))
    daily = F.col("spend") / 25 * F.element_at(F.array(F.lit(0.3), F.lit(1.0), F.lit(4.0)), (p % 3 + 1).cast("int"))
    days = (26 + p % 4 * 5).cast("int")
    x = spend.select("project_id", F.concat(F.lit("project-"), p.cast("string")).alias("name"), F.concat(F.lit("/srv/"), p.cast("string")).alias("path"), daily.alias("baseline_daily_cost"), days.alias("baseline_total_days"))
    x = x.withColumn("baseline_total_cost", F.col("baseline_daily_cost") * F.col("baseline_total_days"))
    budget = F.when(p % 5 != 0, F.col("baseline_total_cost") * (p % 5) / 2)
    meta = F.when(p % 5 != 0, F.concat(F.lit('{"project_type":"agent","model":"gpt-4o","calls_per_day":'), (p % 7 * 10).cast("string"), F.lit(',"budget":'), (p % 5).cast("string"), F.lit("}"))).otherwise("")
    return x.withColumn("budget", budget).withColumn("metadata", meta)


def history(usage: DataFrame) -> DataFrame:
    """Earlier forecasts: the running mean of each week, carried to 30 days."""
    weeks = usage.groupBy("project_id", F.date_trunc("week", "timestamp").alias("week")).agg(F.sum("cost_usd").alias("cost"))
    w = W.partitionBy("project_id").orderBy("week")
    x = weeks.withColumn("iteration", F.row_number().over(w)).withColumn("run", F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return x.select("project_id", "iteration", (F.col("run") / F.col("iteration") * 4.2857143).alias("projected_total"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies in every dialect, well and badly formed, from events."""
    return raw_of(calls(spark, sf_dir))


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, since a plain path has to be a folder
    return raw_of(calls_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")))


def raw_of(c: DataFrame) -> DataFrame:
    i, o, m = F.col("tokens_in").cast("string"), F.col("tokens_out").cast("string"), F.col("model")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    first = t('"usage":{"prompt_tokens":', i, ',"completion_tokens":', o, "}}")
    k = F.col("id") % 13
    body = (
        F.when(k < 3, t('{"model":"', m, '",', first))
        .when(k == 3, t('{"model":"', m, '","usage":{"input_tokens":', i, ',"output_tokens":', o, "}}"))
        .when(k == 4, t('{"id":"', m, '","model":7,', first))
        .when(k == 5, t('{"choices":[{"x":1},{"message":{"model":"', m, '"}}],', first))
        .when(k == 6, t('{"error":{"code":', i, "}}"))
        .when(k == 7, "")
        .when(k == 8, t('{"model":"', m, '","usage":{"prompt_tokens":"many","completion_tokens":', o, "}}"))
        .when(k == 9, t("[", i, ",", o, "]"))
        .when(k == 10, t('{"model":"', m, '",'))
        .when(k == 11, t('{"usage":{"prompt_tokens":', i, ',"output_tokens":', o, "}}"))
        .otherwise(t('{"model":"', m, '",', first))
    )
    return c.select(
        F.when(F.col("id") % 17 != 0, F.col("project_id")).alias("project_id"), F.col("timestamp").alias("received_at"),
        F.when(k == 12, "text/event-stream; charset=utf-8").otherwise("application/json").alias("content_type"), body.alias("body"),
    )


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as logged by hand: a provider that is ignored, metadata that is often empty."""
    c = calls(spark, sf_dir)
    tag = F.create_map(F.lit("tag"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")))
    return c.select("project_id", "timestamp", "model", "tokens_in", "tokens_out", F.lit("someone").alias("provider"), F.when(F.col("id") % 3 == 0, tag).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the files of projects: forty projects, paths and first lines by number."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40 + 1).alias("project_id"), F.floor(F.col("doc_id") / 40).alias("k"), "text")
    n, p = F.col("k").cast("string"), F.col("project_id")
    path = (
        F.when(F.col("k") == 0, "README.md").when((F.col("k") == 1) & (p % 3 == 0), "package.json")
        .when(F.col("k") % 7 == 2, F.concat(F.lit("web/app"), n, F.lit(".ts"))).when(F.col("k") % 7 == 3, F.concat(F.lit("node_modules/m"), n, F.lit(".js")))
        .when(F.col("k") % 7 == 4, F.concat(F.lit("a/b/c/d/e/f/g"), n, F.lit(".py"))).when(F.col("k") % 7 == 5, F.concat(F.lit(".cache/x"), n, F.lit(".tar.gz")))
        .when(F.col("k") % 7 == 6, F.concat(F.lit("docs/Note"), n)).otherwise(F.concat(F.lit("src/mod"), n, F.lit(".py")))
    )
    words = F.element_at(F.array(F.lit("A chatbot. "), F.lit("RAG system for retrieval. "), F.lit("Disk storage. "), F.lit("Notes. ")), (p % 4 + 1).cast("int"))
    head = F.when(F.col("k") == 0, words).when(F.col("k") % 3 == 0, F.when(p % 2 == 0, F.lit("import anthropic\n")).otherwise(F.lit("import  openai\n"))).otherwise(F.lit(""))
    return d.select("project_id", path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
