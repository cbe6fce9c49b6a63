"""A training corpus from raw documents, in five stages. Each stage works on all that the one before kept; what it
returns is written as Parquet and read again, so a lost executor costs one stage at most.

Clean documents pass: only the quality rules and the near-duplicate stage drop rows; line dedup and decontamination
change texts; the last stage replaces texts by ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, jaccard_join, line_dedup, quality_rules, sentencepiece_viterbi
from helixmill.llm._common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


#: Words a shingle and least percent of shared shingles in the near-duplicate stage.
NEAR = (5, 80)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, *NEAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_viterbi.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("sp_ids"), F.lit(0)).cast("long").alias("n_ids"), F.col("sp_ids").alias("ids"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontaminate", leaks), ("sentencepiece", ids)]

#: The quality stage's expectation-maximisation and the last stage's search have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
