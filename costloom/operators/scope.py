"""Baseline estimates from project files (project_id, path, content), all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from costloom.functions import dims

# What the rules look for.
KEYWORDS = ["chatbot", "agent", "rag", "retrieval", "assistant"]
RAG = ["rag", "retrieval"]
SDK = {
    "openai": [r"import\s+openai\b", r"from\s+openai\b", r"require\(['\"]openai['\"]\)", r"from\s+['\"]openai['\"]"],
    "anthropic": [r"import\s+anthropic\b", r"from\s+anthropic\b", r"require\(['\"]@anthropic-ai/sdk['\"]\)", r"from\s+['\"]@anthropic-ai/sdk['\"]"],
}
README = ["README.md", "readme.md", "Readme.md", "spec.md", "CLAUDE.md", ".cursorrules"]
MANIFESTS = ["package.json", "go.mod", "Cargo.toml", "tsconfig.json", "pom.xml"]
EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx"]
SKIPPED = ["__pycache__", "node_modules", "vendor", "venv"]
# Line breaks of any kind, for Java and for RE2.
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
LINE_BREAK_RE2 = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
DEPTH, README_CHARS, LINES, PER_EXTENSION, OVERALL = 6, 2000, 50, 50, 100


def ignored(path: Column) -> Column:
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin(SKIPPED) | p.startswith("."))
    return (F.size(parts) > DEPTH) | bad


def extension(path: Column) -> Column:
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".(\.[^.]+)$", 1)
    return F.when(found == "", "(no ext)").otherwise(found)


def extension_counts(files: DataFrame) -> DataFrame:
    """Files by extension; root manifests count once more under their own names."""
    usual = files.filter(~ignored(F.col("path"))).select("project_id", extension(F.col("path")).alias("ext"))
    roots = files.filter(F.col("path").isin(MANIFESTS)).select("project_id", F.col("path").alias("ext")).distinct()
    return usual.unionByName(roots).groupBy("project_id", "ext").agg(F.count(F.lit(1)).alias("files"))


def readmes(files: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, README)), F.col("path"))
    found = files.filter(F.col("path").isin(README)).groupBy("project_id").agg(F.min_by("content", order).alias("content"))
    return found.select("project_id", F.lower(F.substring("content", 1, README_CHARS)).alias("readme"))


def sdks(files: DataFrame) -> DataFrame:
    """Which SDKs the first lines of the first source files import; the caps come before the ignore rule."""
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("ext"))
    source = files.withColumn("ext", F.regexp_extract(F.col("path"), r"(\.[^./]+)$", 1)).filter(F.col("ext").isin(EXTENSIONS))
    narrow = source.select("project_id", "path", order.alias("kind"))
    first = narrow.withColumn("k", F.row_number().over(W.partitionBy("project_id", "kind").orderBy("path"))).filter(F.col("k") <= PER_EXTENSION)
    first = first.withColumn("k", F.row_number().over(W.partitionBy("project_id").orderBy("kind", "path"))).filter(F.col("k") <= OVERALL)
    read = source.join(first.select("project_id", "path"), ["project_id", "path"], "left_semi").filter(~ignored(F.col("path")))
    head = F.array_join(F.slice(F.split("content", LINE_BREAK), 1, LINES), "\n")
    has = lambda name: F.coalesce(F.bool_or(F.greatest(*[head.rlike(p) for p in SDK[name]])), F.lit(False)).alias(name)
    return read.groupBy("project_id").agg(has("openai"), has("anthropic"))


def _has(words: list[str]) -> Column:
    return F.greatest(*[F.contains(F.col("readme"), F.lit(w)) for w in words])


def baseline_parameters(spark: SparkSession) -> DataFrame:
    """Calls, tokens and daily cost for each kind of project and SDK (six rows)."""
    price = {m: (i, o) for m, i, o in dims.PRICE_ROWS}
    cost = lambda m, i, o: i / 1e6 * price[m][0] + o / 1e6 * price[m][1]
    rows = []
    for anthropic in (False, True):
        large, little = ("claude-3-5-sonnet-latest", "claude-3-5-haiku-latest") if anthropic else ("gpt-4o", "gpt-4o-mini")
        rows.append(("agent", anthropic, large, 80, 2000, 1500, 80 * cost(large, 2000, 1500)))
        rows.append(("rag", anthropic, large, 125, 3000, 1000, 100 * cost("text-embedding-3-small", 1500, 0) + 25 * cost(large, 3000, 1000)))
        rows.append(("default", anthropic, little, 50, 600, 1000, 50 * cost(little, 600, 1000)))
    return F.broadcast(spark.createDataFrame(rows, "project_type string, anthropic boolean, model string, calls_per_day long, tokens_in long, tokens_out long, daily double"))


def baseline(files: DataFrame) -> DataFrame:
    counts = extension_counts(files).groupBy("project_id").agg(F.sum("files").alias("files"))
    x = files.select("project_id").distinct().join(counts, "project_id", "left").join(readmes(files), "project_id", "left").join(sdks(files), "project_id", "left")
    x = x.withColumn("readme", F.coalesce("readme", F.lit(""))).withColumn("files", F.coalesce("files", F.lit(0))).withColumn("anthropic", F.coalesce("anthropic", F.lit(False)))
    kind = F.when(_has(RAG), "rag").when(_has(KEYWORDS), "agent").otherwise("default")
    days = F.when(F.col("files") < 10, 7).when(F.col("files") <= 50, 14).when(F.col("files") <= 200, 21).otherwise(30)
    x = x.withColumn("project_type", kind).withColumn("estimated_days", days).join(baseline_parameters(files.sparkSession), ["project_type", "anthropic"])
    return x.select(
        "project_id", "estimated_days", F.bround("daily", 6).alias("daily_cost"), F.bround(F.col("daily") * days, 6).alias("total_cost"), F.lit("low").alias("confidence"),
        F.lit("heuristic").alias("source"), "project_type", "model", "calls_per_day", "tokens_in", "tokens_out",
    )


def as_projects(found: DataFrame, days: int | None = None, budget: float | None = None) -> DataFrame:
    """Baselines as project rows: days may be set, the budget goes into the metadata."""
    total_days = F.lit(days) if days else F.col("estimated_days")
    total = F.col("daily_cost") * total_days
    meta = F.struct("project_type", "model", "confidence", "calls_per_day", "tokens_in", "tokens_out", *([F.lit(float(budget)).alias("budget")] if budget else []))
    return found.select(
        F.col("project_id").alias("id"), F.col("daily_cost").alias("baseline_daily_cost"), total_days.cast("int").alias("baseline_total_days"), total.alias("baseline_total_cost"), F.to_json(meta).alias("metadata")
    )


def baseline_budget(projects: DataFrame, budget: float) -> DataFrame:
    return projects.select("id", "baseline_total_cost", F.when(F.col("baseline_total_cost") <= budget, "under").otherwise("over").alias("against_budget"))
