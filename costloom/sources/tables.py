"""Reading and writing the engine's own tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from costloom.session import delete, file_system
from costloom.sources import schemas


def read_usage(spark: SparkSession, path: str, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Usage facts from `since` on and before `until`; files written before `source` existed read as 'api'.

    Of a table with day folders only the days of the period are listed and read, with one more on either side, as
    days are those of the writer's time zone.
    """
    df = spark.read.schema(schemas.USAGE).parquet(path)
    for at, sign in ((since, 1), (until, -1)):
        if at is not None:
            inside = F.col("timestamp") >= F.lit(at) if sign > 0 else F.col("timestamp") < F.lit(at)
            edge = F.lit(at.date() - sign * dt.timedelta(days=1))
            day = (F.col("day") >= edge if sign > 0 else F.col("day") <= edge) if "day" in df.columns else F.lit(True)
            df = df.filter(inside & day)
    return df.withColumn("source", F.coalesce("source", F.lit("api"))).select(*schemas.USAGE.names)


def append_usage(usage: DataFrame, path: str) -> None:
    """Appends rows, a folder for each day, so that scans of a period read that period."""
    source = F.coalesce(F.col("source"), F.lit("api")) if "source" in usage.columns else F.lit("api")
    usage.withColumn("source", source).withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def checked(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """rows; whatever reads or writes them fails with the message if one is bad. A filter, so no optimizer leaves it out."""
    return rows.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def add_projects(projects: DataFrame, existing: DataFrame) -> DataFrame:
    """The new rows; a write of them fails, and stores nothing, if one's path is used twice."""
    uses = projects.select("path").unionByName(existing.select("path")).groupBy("path").agg((F.count(F.lit(1)) > 1).alias("__taken"))
    found = projects.join(uses, "path", "left")
    message = F.concat(F.lit("a project with path '"), F.col("path"), F.lit("' exists already"))
    return checked(found, F.coalesce("__taken", F.lit(False)), message).select(*projects.columns)


def project_lookup(projects: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Projects by path, metadata as a struct (null where the text is null or empty)."""
    found = projects if paths is None else projects.filter(F.col("path").isin(paths))
    parsed = F.from_json(F.when(F.col("metadata") != "", F.col("metadata")), schemas.PROJECT_METADATA)
    return found.withColumn("metadata", parsed)


def forecast_history(forecasts: DataFrame) -> DataFrame:
    return forecasts.orderBy("project_id", "iteration")


def newest(usage: DataFrame, n: int, *by: str) -> DataFrame:
    """The newest n rows of each key; Spark keeps n rows a key and task before it shuffles."""
    w = W.partitionBy(*by).orderBy(F.desc("timestamp"), F.desc("id"))
    return usage.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def export_usage(usage: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest rows of each project with the export's columns."""
    return newest(usage, limit, "project_id").select("project_id", *schemas.EXPORT_COLUMNS)


EXACT_TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # Spark's own format drops what is below a millisecond


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", EXACT_TIMES).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", EXACT_TIMES).json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A prompt for each file of a folder."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("prompt_id"), F.col("value").alias("prompt"))


def purge(table: DataFrame, project_ids: DataFrame) -> DataFrame:
    """What is left of a table when projects go (project_ids: project_id)."""
    return table.join(project_ids.select("project_id").distinct(), "project_id", "left_anti")


def reset(usage: DataFrame, forecasts: DataFrame, projects: DataFrame, gone: DataFrame, keep_usage: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usage, forecasts and projects without those of `gone`; usage stays if asked for."""
    left = projects.withColumnRenamed("id", "project_id")
    return (usage if keep_usage else purge(usage, gone)), purge(forecasts, gone), purge(left, gone).withColumnRenamed("project_id", "id")


def purge_stored(spark: SparkSession, path: str, gone: DataFrame) -> tuple[int, int]:
    """Takes projects (gone: project_id) out of a stored table with partitions; how many were rewritten and deleted.

    Only partitions that hold such a project are written again (dynamic overwrite: they are replaced when all tasks have ended);
    those that have nothing else are deleted. The others' files are neither read whole nor touched.
    """
    parts = partition_columns(spark, path)
    if not parts:
        raise ValueError(f"{path} has no partitions; see purge_whole")
    table = spark.read.parquet(path)
    gone = gone.select("project_id").distinct().withColumn("__gone", F.lit(True))
    counts = table.select("project_id", *parts).join(gone, "project_id", "left").groupBy(*parts)
    hit = counts.agg(F.count("__gone").alias("__out"), (F.count(F.lit(1)) - F.count("__gone")).alias("__in")).filter("__out > 0").collect()  # a row a partition
    some, empty = [r for r in hit if r["__in"]], [r for r in hit if not r["__in"]]
    if some:
        first = [r[parts[0]] for r in some]
        wanted = F.col(parts[0]).isin(*{v for v in first if v is not None})  # known before the scan, so other partitions aren't listed
        if None in first:
            wanted = wanted | F.col(parts[0]).isNull()
        affected = F.broadcast(spark.createDataFrame([tuple(r[p] for p in parts) for r in some], table.select(*parts).schema))
        same = [table[p].eqNullSafe(affected[p]) for p in parts]
        rows = table.filter(wanted).join(affected, same, "left_semi").join(gone, "project_id", "left_anti").select(*table.columns)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for r in empty:
        delete(spark, "/".join([path, *(f"{p}={'__HIVE_DEFAULT_PARTITION__' if r[p] is None else r[p]}" for p in parts)]))
    return len(some), len(empty)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns that a table's folders are named by, outermost first."""
    files, where = file_system(spark, path)
    out = []
    while folders := [f.getPath() for f in files.listStatus(where) if f.isDirectory() and "=" in f.getPath().getName()]:
        out.append(folders[0].getName().split("=")[0])
        where = folders[0]
    return out


def purge_whole(spark: SparkSession, path: str, gone: DataFrame, key: str = "project_id") -> None:
    """As purge_stored for a table without partitions (projects, forecasts: small ones): written beside, then put in place."""
    rest = purge(spark.read.parquet(path).withColumnRenamed(key, "project_id"), gone).withColumnRenamed("project_id", key)
    rest.write.mode("overwrite").parquet(f"{path}-rest")
    files, old = file_system(spark, path)
    files.delete(old, True)
    files.rename(file_system(spark, f"{path}-rest")[1], old)


def reset_stored(spark: SparkSession, usage: str, forecasts: str, projects: str, gone: DataFrame, keep_usage: bool = False) -> None:
    """reset() of stored tables (paths); usage stays untouched if asked for."""
    if not keep_usage:
        purge_stored(spark, usage, gone)
    purge_whole(spark, forecasts, gone)
    purge_whole(spark, projects, gone, "id")
