"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs; all
but the last keep the columns of documents. Nulls and empty texts follow the operators: a null text is empty; rows
without an id pass the filters by their text and are near duplicates of one another only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import near_dup, packing, quality, toxicity
from stockflow.llm.common import written

KEEP_QUALITY = 0.5
DROP_TOXIC = 0.7
CAPACITY = 2048
END_ID = 0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer keeps."""
    return docs.where(quality.scorer(quality.learn(docs))(F.col("text")) >= KEEP_QUALITY)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learnt from the labels of these documents that are not held out."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(model)(F.col("text")) < DROP_TOXIC)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in the training sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [("quality classifier", good_quality), ("toxicity", not_toxic), ("near duplicates", one_of_each), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
