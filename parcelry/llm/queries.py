"""Registered queries of the text operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelry.llm import bpe, decontaminate, exact_dedup, html_extract, language_id, near_dedup, secret_scan, sentence_pieces, substring_dedup, token_alignment, toxicity, warc, whitening
from parcelry.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op2_secrets(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op3_simhash(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op4_language_id(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    return bpe.op6_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op7_warc(table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op8_html_text(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op9_substring_dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    return token_alignment.op11_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(a), public_tokenizers.path(b))


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return sentence_pieces.op12_sentencepiece(table(spark, sf_dir, "documents"), public_tokenizers.path(model))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13_whitening(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_secrets": op2_secrets,
        "op3_simhash": op3_simhash,
        "op4_language_id": op4_language_id,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_bpe": op6_bpe,
        "op7_warc": op7_warc,
        "op8_html_text": op8_html_text,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_alignment": op11_alignment,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op7_warc": warc.SQL}
