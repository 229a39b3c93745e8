"""Helpers shared by the corpus operators: reading, cutting lineage, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and an RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that Spark hands to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables.

    Texts may be long, so the session's Arrow batches are made smaller; the batch size has no
    influence on results.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which free memory goes back to the machine.

    Spark keeps a worker for later tasks, and with it all that it has not given back.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, so nothing is computed twice and a lost executor costs no rework.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that a join may broadcast (about 16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges`` (columns ``a`` and ``b``).

    Each round takes the smallest label among a vertex and its neighbours and then the label
    of that label (pointer jumping), so the rounds grow with the logarithm of the longest
    chain. Labels stay distributed; only a count of changes reaches the driver.
    Up to ``BROADCAST_IDS / 4`` labels, which are counted first, are broadcast, so that no shuffle
    gathers the edges of a vertex; beyond that joins shuffle and split skewed vertices at run time.
    Returns ``id`` and ``component``; isolated vertices do not appear. Loops and null ends
    are ignored, repeated edges count once.
    """
    real = edges.where("a <> b").select("a", "b")
    both = saved(real.union(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    few = labels.count() <= BROADCAST_IDS // 4
    side = lambda df: F.broadcast(df) if few else df.hint("merge")
    while True:
        near = both.join(side(labels.select(F.col("id").alias("b"), "component")), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = saved(labels.join(side(near), "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old")))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = saved(step.join(side(up), "component").select("id", F.col("top").alias("component"), (F.col("top") != F.col("old")).alias("changed")))
        if labels.where("changed").isEmpty():
            return labels.select("id", "component")


def join_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """``df`` joined (left_semi, left_anti) with a one-column table of distinct ids.

    The ids are saved and counted first: up to ``BROADCAST_IDS`` they are broadcast, so that the
    wide rows of ``df`` stay where they are; beyond that both sides are shuffled.
    """
    few = saved(ids)
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few.hint("merge"), column, how)
