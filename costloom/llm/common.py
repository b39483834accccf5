"""What the operators share: shared-folder tables, worker shipping, bounded slices and checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from costloom.session import shared_dir

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession) -> str:
    if not _written:
        atexit.register(_clear, spark)
    path = f"{shared_dir(spark)}/costloom-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, whole if executors are lost later."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def _clear(spark: SparkSession) -> None:
    """At the end of the driver's program, tables that are still there go."""
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in list(_written):
            delete(spark, path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators write inside; for callers that have stored the result by the end."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            delete(spark, path)


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Inside, each job's shuffle files go at its end; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marks df for broadcast if a count shows at most `rows` rows; otherwise Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None, count: str | None = None) -> DataFrame:
    """keys and __parts of the keys that very many rows have, for a broadcast.

    A key is hot if it has over 1,000 rows and over one in 100,000 of all, so there are at most 100,000 hot ones.
    total: the number of rows; count: a column that has it for each key; where these are known.
    """
    if total is None:
        total = (rows.agg(F.sum(count).alias("n")).first()["n"] or 0) if count else rows.count()
    most = max(1000, total // 100_000)
    counted = rows.select(*keys, F.col(count).alias("count")) if count else rows.groupBy(*keys).count()
    return F.broadcast(counted.filter(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("__parts")))


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a lookup of one row a key, where a key may be that of very many rows.

    Hot keys are dealt over parts by a hash of the column `by`, and their row of the lookup goes to each part.
    """
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    spread = lookup.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(spread, [*keys, "__salt"], how).drop("__salt")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on, tasks of this session get Arrow batches of at most so many rows: whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast whose classes travel by value, so that executors need no copy of this package; see opened()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    return pickle.loads(shared.value)


def row_schema(fields: list[StructField], more: str) -> StructType:
    """Fields of a given table and further ones as DDL; names of the former may be any."""
    return StructType([*fields, *StructType.fromDDL(more).fields])


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about `size` bytes in a string or binary column (a larger value is a part of its own)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False) + 1)
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = max(at + 1, stop)
            yield b.slice(at, stop - at)
            at = stop


def stream_past(index: DataFrame, queries: DataFrame, shards: int, start: Callable, schema: str) -> DataFrame:
    """Queries searched in the index of their shard, a task for each of `shards` shards.

    Both frames have an int column `shard` (from 0); columns that one of them lacks are null. In a task the index rows come
    first and are held: start(table of them) gives a search. Queries stream past it a batch at a time, in any number:
    search(batch) yields batches of `schema`. A shard without index rows finds nothing.
    """
    both = index.withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "side")
    shard_at, side_at = both.columns.index("shard"), both.columns.index("side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, search = None, [], None
        for b in batches:
            shard, side = (b.column(c).to_numpy().astype(np.int64) for c in (shard_at, side_at))
            cuts = np.flatnonzero(np.diff(shard * 2 + side)) + 1 if b.num_rows else []
            for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
                if s == e:
                    continue
                if shard[s] != at:
                    at, held, search = shard[s], [], None
                if side[s] == 0:
                    held.append(b.slice(s, e - s))
                    continue
                if search is None and held:
                    search, held = start(pa.Table.from_batches(held)), []
                if search is not None:
                    yield from search(b.slice(s, e - s))

    return dealt.mapInArrow(run, schema)


def shards_for(spark: SparkSession, size: int, most: int, least: int) -> int:
    """Shards such that one has about `most` bytes at most, and as many as there are cores where each has `least`."""
    return max(1, -(-size // most), min(spark.sparkContext.defaultParallelism, size // least))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
