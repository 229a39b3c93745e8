"""Scratch tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only where none is set and Spark runs on one machine (tests), a temporary folder is named.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/scratch/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: no later step computes it anew, whatever executor is lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, key: str | list[str], rows: int, each: int) -> DataFrame:
    """``df`` parted by ``key`` (one column or several) into parts of about ``each`` of its ``rows``, whatever these grow to later in the plan.

    Spark sizes parts by what is shuffled; where small rows become many later, that is too much for one task.
    """
    return df.repartition(max(rows // each + 1, df.sparkSession.sparkContext.defaultParallelism), *([key] if isinstance(key, str) else key))


#: Rows of a table of ids that a join may broadcast.
SMALL = 500_000


def side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL else df
