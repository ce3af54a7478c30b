"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the last return the columns of ``documents``, further ones included.

Defined results, each from its operator: a null or empty text has no letter and goes in the first stage; a very long text is worked on whole; of
exact and near copies, repeated rows too, the smallest id stays, once; rows without an id are never removed as copies; an empty table passes every stage as an empty one; helper columns take
names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import decontaminate, langid, neardup, packing, pii
from dyadlake.llm import shared as S


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. The posterior of the learned languages is near 1 for any longer text, one in no learned language included, so in effect only ``und`` is rejected."""
    return langid.accepted(docs, langid.train(docs.where(F.col("lang").isNotNull())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates (shingles of five words, similarity 0.8)."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 2048 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("PII", personal_data), ("packing", packed)]
#: SQL can express neither the models nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = S.materialize(docs)
    return docs
