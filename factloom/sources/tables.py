"""Input tables, and views that bind them to symbols, references, objects, logs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import parted

#: Lines of orders that one task makes distinct.
LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols: id, name, name_norm, kind, component."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_norm"), F.col("p_type").alias("kind"), F.col("p_brand").alias("component"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """References from orders to parts: src, dst, owner, kind, resolution, confidence, line."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("kind"),
        F.when(F.col("l_linestatus") == "F", "resolved").otherwise("unresolved").alias("resolution"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), F.col("l_linenumber").alias("line"),
    )


def _node(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects: id ("kind:key"), mtype, name."""
    parts = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
    out = None
    for name, key, label in parts:
        one = table(spark, d, name).select(_node(name, key).alias("id"), F.lit(name).alias("mtype"), F.col(label).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Object edges: src, dst, kind, layer. Foreign keys, and distinct supplier-part pairs by layer."""
    fk = (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"))
    out = None
    for name, key, to, by in fk:
        one = table(spark, d, name).select(_node(name, key).alias("src"), _node(to, by).alias("dst"), F.lit(f"{name}-{to}").alias("kind"), F.lit("base").alias("layer"))
        out = one if out is None else out.unionByName(one)
    # distinct numbers first, texts after; few lines are alike, so they are parted by their number before any task groups them
    lines = table(spark, d, "lineitem")
    own = parted(lines.select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("ext")), ["l_partkey", "l_suppkey"], lines.count(), LINES).distinct()
    pairs = own.select(_node("part", "l_partkey").alias("src"), _node("supplier", "l_suppkey").alias("dst"), F.lit("part-supplier").alias("kind"), F.when(F.col("ext"), "ext-a").otherwise("base").alias("layer"))
    return out.unionByName(pairs)
