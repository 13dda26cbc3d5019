"""From raw documents to token files: five stages, each on all that the one before it kept.

1. quality: documents that the robust outlier rules reject go (operator 5).
2. near-duplicates: of each group that shares 80 % of its five-word shingles one stays (8).
3. decontamination: documents that hold a benchmark item go (4).
4. mixing: documents come as often as their source's target weight asks (9).
5. tokens: what is left is written as ORC files of token ids and indexed (2).

``STAGES`` lists them.  A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``.  ``run`` writes each stage's result as Parquet to the shared folder and reads it
again.  SQL cannot express minimum covariance determinants and tokenizers: ``ORACLE_SQL`` is
None, and tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, mixing, neardup, quality, token_orc
from gleaner.llm.common import table
from gleaner.session import store


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_orc.tokenize_to_orc(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("mixing", mixed_sources),
    ("tokens", token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files that the last stage writes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
