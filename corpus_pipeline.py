"""From raw documents to token ids: quality rules, exact and near dedup, mixing, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsearch.llm import bpe, exact_dedup, mixing, quality, simhash
from quillsearch.llm.common import table, written
from quillsearch.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.thinned(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trips(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("exact", exact_duplicates), ("near", near_duplicates), ("mix", mix_to_targets), ("encode", encode)]

#: A trained classifier, hash fingerprints and a vocabulary file have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
