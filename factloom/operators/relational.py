"""Lookups, pages, differences and combinations over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, all together."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """Rows after a key in order, with one more than ``limit`` to show that there is another page."""
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, after):
            later = later | (equal & (F.col(k) > F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        df = df.where(later)
    return df.orderBy(*keys).limit(limit + 1)


def tier(name: Column, wanted: str) -> Column:
    """0 for the exact name, 1 for a prefix, 2 for a part of it, else null."""
    return F.when(name == wanted, 0).when(name.startswith(wanted), 1).when(name.contains(wanted), 2)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key`` and ``side``: only_a, only_b or common."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").select(key, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("common").alias("side"))


def slice_last(df: DataFrame, dims: list[str], period: str, until: Column, tie: str) -> DataFrame:
    """Last row of every combination of dimensions up to and with ``until``; each task keeps only its own last rows."""
    rest = [c for c in df.columns if c not in dims]
    last = df.where(F.col(period) <= until).groupBy(*dims).agg(F.max_by(F.struct(*rest), F.struct(period, tie)).alias("_last"))
    return last.select(*dims, "_last.*").select(df.columns)


def top_by(df: DataFrame, section: list[str], n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of each section with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*section).orderBy(*order))).where(F.col("rank") <= n)


def holds(c: Column, part: str) -> Column:
    """Whether a text holds ``part`` literally, in any case."""
    return F.lower(c).contains(part.lower())


def in_list(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in a list of any length."""
    return df.join(asked.select(key).distinct(), key, "left_semi")


def within(region: Column, roots: list[str]) -> Column:
    """Whether a region is one of ``roots`` or below it."""
    return reduce(lambda a, r: a | (region == r) | region.startswith(r + "/"), roots, F.lit(False))


def typed_difference(a: DataFrame, b: DataFrame, kind: str, name: str) -> DataFrame:
    """``kind``, ``name`` and ``side``; names of a kind that one side lacks are "not comparable"."""
    x, y = (df.select(kind, name).distinct().withColumn(c, F.lit(1)) for df, c in ((a, "_a"), (b, "_b")))
    both = x.join(y, [kind, name], "full")
    known = both.groupBy(kind).agg(F.max("_a").alias("_ka"), F.max("_b").alias("_kb"))
    side = F.when(F.col("_ka").isNull() | F.col("_kb").isNull(), "not comparable").when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("common")
    return both.join(known, kind).select(kind, name, side.alias("side"))


def checklist(wanted: DataFrame, have: DataFrame, keys: list[str], enough: int) -> DataFrame:
    """``keys`` of what is wanted and its ``status``: done, partial (fewer than ``enough``) or not done."""
    found = wanted.join(have.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left")
    return found.select(*keys, F.when(F.col("_n").isNull(), "not done").when(F.col("_n") < enough, "partial").otherwise("done").alias("status"))


def first_spelling(df: DataFrame, name: str, place: str) -> DataFrame:
    """``key`` (lower case), its ``first`` spelling by place and the number of spellings' rows."""
    return df.groupBy(F.lower(name).alias("key")).agg(F.min_by(name, place).alias("first"), F.count("*").alias("n"))


def movements(declared: DataFrame, used: DataFrame) -> DataFrame:
    """``object, register, state, fields``: declared, used (with the ``field``s set) or both."""
    d = declared.select("object", "register").distinct().withColumn("_d", F.lit(1))
    u = used.groupBy("object", "register").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    state = F.when(F.col("fields").isNull(), "declared").when(F.col("_d").isNull(), "used").otherwise("both")
    return d.join(u, ["object", "register"], "full").select("object", "register", state.alias("state"), F.coalesce("fields", F.lit("")).alias("fields"))


def budget_prefix(df: DataFrame, section: str, cost: str, tie: str, budget: int) -> DataFrame:
    """``section, tie, used``: the cheapest rows of each section until the budget would overflow.

    Rows of one cost are counted first, so the running total is over the different costs up to the
    budget; within a cost it is the row's number, of which only as many are kept as can fit.
    """
    rows = df.where(F.col(cost) <= budget)
    levels = rows.groupBy(section, cost).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(section).orderBy(cost).rowsBetween(W.unboundedPreceding, 0)
    levels = levels.withColumn("_before", F.sum(F.col("_n") * F.col(cost)).over(upto) - F.col("_n") * F.col(cost)).where(F.col("_before") <= budget).drop("_n")
    numbered = rows.join(levels, [section, cost]).withColumn("_k", F.row_number().over(W.partitionBy(section, cost).orderBy(tie))).where((F.col(cost) == 0) | (F.col("_k") <= budget + 1))
    return numbered.select(section, tie, (F.col("_before") + F.col("_k") * F.col(cost)).alias("used")).where(F.col("used") <= budget)
