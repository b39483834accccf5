"""From raw documents to token ids: five stages, each over all that its predecessor kept.

All but the last return rows of `documents` with all their columns; the last returns a row of token counts and
digests for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costloom.llm import exact_dedup, language, mixing, ngram_join, pieces
from costloom.llm.common import new_path, passing, table
from costloom.llm.registry import VOCABULARY

NEAR_WORDS, NEAR_SHARE = 5, (80, 100)
MIX_SHARE, MIX_SEED = 0.7, 11


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or coded badly by every learned language."""
    return language.accepted(docs, language.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least id stays."""
    return ngram_join.drop_near_copies(docs, width=NEAR_WORDS, share=NEAR_SHARE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights at each node of the tree of domains, languages and sources; each document once at most."""
    return mixing.take_mix(docs, share=MIX_SHARE, seed=MIX_SEED)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(docs, pieces.model_bytes(VOCABULARY), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mix),
    ("sentencepiece", token_ids),
]
ORACLE_SQL = None  # language models, components and the tokenizer have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        result = new_path(spark)
        with passing(spark):  # what a stage wrote inside goes once its result is stored
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(result)
        docs = spark.read.schema(rows.schema).parquet(result)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
