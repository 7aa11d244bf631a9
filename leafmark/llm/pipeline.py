"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
`documents` (n_chars follows the text); the last returns the pieces of the packed sequences. A document whose
lines or words all occur elsewhere stays, with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common, line_dedup, minhash, packing, quality_rules, substring_dedup


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_by_quality(docs, quality_rules.train(docs, common.table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.drop_repeated_passages(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("substring_dedup", passages), ("best_fit_packing", packed)]

#: SQL has no CRF, no consistent sampling and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote, and its input, is deleted once its own result is written."""
    docs, since = common.table(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        common.delete(since, keep_last=True)
    return docs
