"""The registered queries of the corpus operators; each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, exact_dedup, fingerprint, html_blocks, line_quality, mixing, ngram_join, pii, sentence_spans, spelling, token_alignment, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op1_rows(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_rows(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3_rows(table(spark, sf_dir, "documents"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.op4_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.op5_rows(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op6_rows(table(spark, sf_dir, "documents"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.op7_rows(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op8_rows(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op9_rows(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op11_rows(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.op12_rows(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op13_rows(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_mix_sources, op3_pii, op4_line_quality, op5_sentence_spans, op6_fingerprints, op7_html_blocks, op8_byte_bpe, op9_ngram_join, op10_toxicity, op11_chat_format, op12_token_alignment, op13_spelling)}
