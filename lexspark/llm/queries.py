"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the
SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binary, decontam, langid, licenses, lm, mixing, ngramjoin, quality, tokens, toxicity
from .common import read

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary.encode(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_token_counts, op3_lm_score, op4_language_id, op5_toxicity, op6_quality_rules, op7_license_scan, op8_token_binary, op9_decontamination, op10_ngram_jaccard)}

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": quality.SQL, "op7_license_scan": licenses.sql(), "op9_decontamination": decontam.SQL, "op10_ngram_jaccard": ngramjoin.SQL}
