"""From raw documents to shards: five stages, each written and read again before the next.

Every stage works on all that its predecessor kept. Toxic documents go, one document of each
group of near copies stays, documents that hold a benchmark item go, the rest is mixed to the
sources' weights in training order (a document appears as often as the mix takes it), and at last
dealt into shards.

The documents of every stage are a stored table, so their rows have fixed numbers. Defined cases hold for
all stages: null and empty texts, null and repeated ids, repeated rows, empty tables and columns of
other names are taken as they are; what a stage makes of them is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from factloom.llm.common import saved, table

#: Shingle words and least similarity of near copies.
WORDS, SIMILARITY = 5, 0.8
SHARDS = 16


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; texts without words score 0 and stay, repeated rows score alike."""
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, weights)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null last, of equal ids one row.

    A row goes for its own text only; texts without words all stay.
    """
    return simhash.keep_one(docs, WORDS, SIMILARITY, stored=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item covers by half; texts without words stay, repeated rows go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the sources' weights ask; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; rows that repeat text and id are parted by their number."""
    return sharding.shard_records(docs, SHARDS, stored=True)


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training, similarity components and tiling have no SQL form; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None
