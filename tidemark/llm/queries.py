"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, ftrl, language, linededup, lm, mixing, neardup, quality, secrets, spelling, substrings, tokens
from .common import documents

#: The tokenizer's file; it is read where it lies, on every machine.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("item_ids")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(documents(spark, sf_dir), TOKENIZER).drop("file")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs.filter(F.coalesce(~held_out, F.lit(True))))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = ftrl.fit(docs, labels.filter(~held_out))
    return ftrl.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scores, op2_line_dedup, op3_secret_scan, op4_jaccard_join, op5_substring_dedup, op6_quality_rules, op7_decontamination, op8_token_output, op9_language_id, op10_mixing, op11_source_divergence, op12_spelling_variants, op13_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL}
