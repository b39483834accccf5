"""Continuous ingest, live totals and live buckets with Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from costloom.operators.aggregates import bucket_label
from costloom.session import delete, file_system
from costloom.sources import ingest, schemas

log = logging.getLogger(__name__)
FLUSH = "2 seconds"
REFRESH = "5 seconds"
OBSERVED = "ingest"
COMPACT = 100  # batches between full versions of the totals
TOTALS = "project_id long, calls long, total_tokens long, spend double"


def raw_stream(spark: SparkSession, path: str, kind: str = "json", **options) -> DataFrame:
    return spark.readStream.format(kind).schema(schemas.RAW).options(**options).load(path)


class Counters(StreamingQueryListener):
    """What streams have counted so far: responses by status, and rows that came after their window was closed."""

    def __init__(self):
        self.responses = dict.fromkeys(ingest.STATUSES, 0)
        self.late = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if found := event.progress.observedMetrics.get(OBSERVED):
            for status in self.responses:
                self.responses[status] += found[status]
        self.late += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_ingest(raw: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Appends priced usage as it comes in, in folders by day and batch: a batch that is run again replaces itself.

    Counts by status come with the query's progress (Counters adds them up). on_batch sees each batch's rows after they are
    stored; its failure is logged and does not stop the query.
    """
    usage = ingest.ingest(raw, observation=OBSERVED).withColumn("day", F.to_date("timestamp"))

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            # other batches' folders stay
            rows = batch.withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
            if on_batch is not None:
                try:
                    on_batch(batch, number)
                except Exception:
                    log.exception("usage hook failed")
        finally:
            batch.unpersist()

    writer = usage.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(once, FLUSH)).start()


def _trigger(once: bool, every: str) -> dict:
    return {"availableNow": True} if once else {"processingTime": every}


def live_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend")
    )


def live_buckets(usage: DataFrame, minutes: int = 15, lateness: str = "10 minutes") -> DataFrame:
    """Buckets anchored at the hour, as in bucketed_costs; calls later than `lateness` are left out.

    A bucket comes when it is closed; sizes that don't divide an hour come when their hour is.
    """
    w = F.window("timestamp", f"{minutes} minutes" if 60 % minutes == 0 else "1 hour")
    bucket = bucket_label(F.col("timestamp"), minutes).alias("bucket")
    out = usage.withWatermark("timestamp", lateness).groupBy("project_id", w, bucket).agg(
        F.sum("cost_usd").alias("cost"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens")
    )
    return out.select("project_id", "bucket", "cost", "total_tokens")


def live_sizes(usage: DataFrame, sizes: Sequence[int] = (15, 5, 1), lateness: str = "10 minutes") -> DataFrame:
    """project_id, minutes, bucket, cost, total_tokens: buckets of all sizes from one stream, by chained windows.

    Calls are summed by minute; the minutes' sums, as they are closed, go on to all sizes. All buckets of the widest size's window
    come when it is closed.
    """
    minute = usage.withWatermark("timestamp", lateness).groupBy("project_id", F.window("timestamp", "1 minute")).agg(
        F.sum("cost_usd").alias("cost"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens")
    )
    closed = minute.select("project_id", F.window_time("window").alias("at"), "cost", "total_tokens")
    sized = closed.withColumn("minutes", F.explode(F.array(*map(F.lit, sizes))))
    w = F.window("at", f"{max(sizes)} minutes" if all(60 % k == 0 and max(sizes) % k == 0 for k in sizes) else "1 hour")
    out = sized.groupBy("project_id", "minutes", w, bucket_label(F.col("at"), F.col("minutes")).alias("bucket"))
    return out.agg(F.sum("cost").alias("cost"), F.sum("total_tokens").alias("total_tokens")).drop("window")


def start_totals(usage: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps live_totals() as a table of versions; read_totals() reads it at any time, from any program.

    The totals are the stream's state; a batch writes the projects that have changed, as folder `delta=number`. Every
    COMPACT batches it writes all projects instead, as `full=number`, and the next one deletes what is older. A batch that is run
    again after a failure writes the same folder.
    """
    spark = usage.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        full, _ = _versions(spark, path, number)
        if full is not None:  # committed, as a later batch runs
            for kind, n, name in _folders(spark, path):
                if n < full:
                    delete(spark, f"{path}/{name}")
        if number and number % COMPACT == 0:
            _latest(_read_versions(spark, path, number), batch.withColumn("version", F.lit(number))).write.mode("overwrite").parquet(f"{path}/full={number}")
        else:
            batch.write.mode("overwrite").parquet(f"{path}/delta={number}")

    writer = live_totals(usage).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(once, REFRESH)).start()


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(kind, number, name) of the versions that are complete."""
    files, where = file_system(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    done = [n for n in names if "=" in n and files.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted((n.split("=")[0], int(n.split("=")[1]), n) for n in done)


def _versions(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, list[tuple[int, str]]]:
    """The newest full version before a number, and it with all later deltas."""
    folders = [f for f in _folders(spark, path) if before is None or f[1] < before]
    full = max((n for kind, n, _ in folders if kind == "full"), default=None)
    return full, [(n, name) for kind, n, name in folders if full is None or n > full or (n == full and kind == "full")]


def _read_versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    found = None
    for n, name in _versions(spark, path, before)[1]:  # COMPACT at most
        df = spark.read.schema(TOTALS).parquet(f"{path}/{name}").withColumn("version", F.lit(n))
        found = df if found is None else found.unionByName(df)
    return found


def _latest(*rows: DataFrame | None) -> DataFrame:
    every = reduce(DataFrame.unionByName, [r for r in rows if r is not None])
    newest = F.max_by(F.struct("calls", "total_tokens", "spend"), "version").alias("t")
    return every.groupBy("project_id").agg(newest).select("project_id", "t.*")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """project_id, calls, total_tokens, spend: the newest version of each project."""
    found = _read_versions(spark, path)
    return spark.createDataFrame([], TOTALS) if found is None else _latest(found)
