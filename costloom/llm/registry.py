"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.llm import ball_search, exact_dedup, html_text, language, lexical, mixing, neighbours, ngram_join, pieces, pii, spelling, substring, suffix_index
from costloom.llm.common import table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), pieces.model_bytes(VOCABULARY))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.drop_repeated_bytes(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeated(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=0.5, epochs=2, weights={"lang": {"en": 2.0}})


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.train(pages), keep=["page_id", "url"])


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_neighbours": op2_neighbours,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_ngram_join": op5_ngram_join,
        "op6_language_id": op6_language_id,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_mixing": op9_mixing,
        "op10_html": op10_html,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_lexical_search": op12_lexical_search,
        "op13_exact_topk": op13_exact_topk,
    }


def oracle_sql() -> dict:
    return {
        "op5_ngram_join": ngram_join.ORACLE_SQL,
        "op7_substring_dedup": substring.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_spelling_variants": spelling.ORACLE_SQL,
        "op12_lexical_search": lexical.ORACLE_SQL,
        "op13_exact_topk": ball_search.ORACLE_SQL,
    }
