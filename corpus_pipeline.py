"""From raw documents to a training mixture: five stages, each over all rows the last one kept.

Language identification drops documents without an identifiable language; line dedup removes
cross-site lines, and with them documents that had nothing else; SimHash keeps one document of
each group of near duplicates; decontamination drops documents that hold a benchmark item;
mixing repeats and shuffles what is left by source. All columns of ``documents`` pass through
every stage; mixing adds ``copy`` and ``shuffle_key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duskline.llm import decontaminate, language, linespread, mixing, simhash
from duskline.llm.text import spare
from duskline.sources.scratch import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on; null and letterless texts go. All stay if nothing is labelled."""
    return language.with_known_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose every line they had go; those that were blank before stay."""
    count = spare(docs, "lines_removed")
    out = linespread.drop_spread_lines(docs, count=count)
    return out.filter((F.col(count) == 0) | (F.trim(F.translate("text", "\n", " ")) != "")).drop(count)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, the one with the smallest id goes on; empty and null texts are one group."""
    return simhash.one_of_each(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, shuffled; texts play no part, a null source is one."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]

#: XXH64 and the naive Bayes classifier are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
