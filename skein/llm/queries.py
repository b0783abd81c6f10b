"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, decontaminate, fingerprint, html_extract, line_dedup, maxent_lm, ngram_join, substring_dedup, token_store, toxicity
from skein.llm.common import table

#: The vocabulary's folder; nothing of it is kept in this repository.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "")


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "item_id", "cast(same as bigint) AS same")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocab_path())


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(table(spark, sf_dir, "documents"), vocab_path())


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents")).drop("th")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_token_store": op6_token_store,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_extract": op8_html_extract,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE.replace("{docs}", "documents"),
    "op4_decontaminate": decontaminate.ORACLE.replace("{docs}", "documents"),
}
