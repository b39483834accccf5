"""Exact dedup by skew-safe combining (native: DataFrame functions only).

Rows are first combined within their own task, then per (digest, salt, whole text), and the salt
winners per (digest, whole text). No stage trusts a digest: the whole text is part of every
grouping key, so equal digests of different texts stay apart. A task's rows have one salt, so a group that
holds a third of all rows meets as one row a task, in `salts` parts. The winner goes back to the rows of a large
group in parts, too, by the group's size.

Defined cases: a null text counts as empty; a null id loses to any other; rows that repeat an id and
a text are each reported, with equal results; an empty table gives an empty result; other columns,
whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costloom.llm.common import hot_keys, shared_dir, small, spread_join, text_or_empty

SALTS = 64


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        text_or_empty(text_col).alias("content"),
    ).select(
        "id",
        "content",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        (F.spark_partition_id() % salts).alias("salt"),
    )


def _winners(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: the id that stays and the number of rows."""
    salted = keyed.groupBy("digest", "salt", "content").agg(
        F.max("id").alias("best"), F.count(F.lit(1)).alias("n")
    )
    return salted.groupBy("digest", "content").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256."""
    shared_dir(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col, salts)
    winners = _winners(keyed)
    classes = winners.select("digest", "keep_id", "group_size").checkpoint()
    # Different texts under one digest: never seen, but then those rows are matched by text as well.
    clashing = classes.groupBy("digest").count().filter("count > 1").select("digest").checkpoint()
    clash = not clashing.isEmpty()
    plain = classes.join(clashing, "digest", "left_anti") if clash else classes
    # in parts, so that the hot group is not met whole here either
    rows = keyed.select("id", "digest")
    found = spread_join(rows, plain, ["digest"], "id", hot_keys(plain, ["digest"], count="group_size")).select("id", "digest", "keep_id", "group_size")
    if clash:
        odd = keyed.join(small(clashing), "digest", "left_semi").select("id", "digest", "content")
        found = found.unionByName(odd.join(winners, ["digest", "content"]).select(found.columns))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs, all columns, that stay: one for each distinct text.

    The winner is matched by its id and digest; where several rows carry both (repeated rows), one stays.
    """
    name = F.coalesce(F.col("__id").cast("string"), F.lit(""))
    winners = _winners(_keyed(docs, id_col, text_col, salts)).select(F.col("keep_id").alias("__id"), F.col("digest").alias("__digest"))
    winners = winners.select(name.alias("__name"), "__digest")
    sealed = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    sealed = sealed.select("__row", name.alias("__name"), F.unhex(F.sha2("__text", 256)).alias("__digest"))
    kept = sealed.join(winners, ["__name", "__digest"], "left_semi")
    return kept.groupBy("__name", "__digest").agg(F.first("__row").alias("__row")).select("__row.*")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
