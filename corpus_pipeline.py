"""Corpus cleaning in five stages; each works on all that the one before it kept.

quality rules, n-gram Jaccard join, benchmark decontamination, mixing sources to target
weights, token-ID output. All but the last return the columns of `documents`.

Null and empty texts fail the quality rules. Rows with a null id and different texts of
one id are documents of their own; near copies of them go like others, and of a repeated
row one stays. Of a group of near copies the smallest id stays. Ties in the mix go by a
hash of the document. Texts of any length are handled whole, empty tables give no rows,
and further columns, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, neardup, quality, tokens
from tidemark.llm.common import documents, shared_dir, stored
from tidemark.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go."""
    return quality.keep_good(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.keep_first(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of test items are cut; documents that consist mostly of them go."""
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files, and where each document lies in them."""
    return tokens.token_table(docs, TOKENIZER)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", cut_benchmark), ("mixing", mix_sources), ("tokens", write_ids)]
#: The stages hold a classifier and a tokenizer, which SQL has not; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each written as Parquet and read again."""
    docs, at = documents(spark, sf_dir), shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
