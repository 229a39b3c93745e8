"""Checks whose findings are rows: rights, coverage, conflicts, generations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def similar(name: Column, asked: str) -> Column:
    """Whether either name holds the other, or they share four letters and 70 % of the shorter one."""
    a = F.lower(name)
    shared = reduce(lambda n, k: F.when(a.startswith(asked.lower()[:k]), k).otherwise(n), range(1, len(asked) + 1), F.lit(0))
    return a.contains(asked.lower()) | F.lit(asked.lower()).contains(a) | ((shared >= 4) & (shared * 10 >= F.least(F.length(a), F.lit(len(asked))) * 7))


def rights_pivot(grants: DataFrame, roles: DataFrame) -> DataFrame:
    """``right`` with its granting, refusing and undetermined roles, each in order.

    ``grants`` have ``role``, ``right``, ``value``; ``roles`` have ``role`` and ``for_new`` (rights on
    all objects that the role doesn't name). A role that says nothing is undetermined when
    ``for_new`` is set, else it doesn't grant. A role that grants once grants.
    """
    stated = grants.groupBy("right", "role").agg(F.bool_or("value").alias("value"))
    every = stated.select("right").distinct().join(roles)  # every right with every role is the result itself
    state = F.when(F.col("value"), "granted").when(F.col("value").isNull() & F.col("for_new"), "undetermined").otherwise("refused")
    each = every.join(stated, ["right", "role"], "left").withColumn("state", state)
    of = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("role")))), ",")
    return each.groupBy("right").agg(of("granted").alias("granted"), of("refused").alias("refused"), of("undetermined").alias("undetermined"))


def affected(changed: DataFrame, references: DataFrame) -> DataFrame:
    """One row: references and files that consulted a changed key, and whether to rebuild in full.

    ``changed`` has ``key``; ``references`` have ``key`` and ``file``. Full means more than 5,000
    references and a tenth of them, or more than half of the files.
    """
    hit = references.join(changed.select("key").distinct().withColumn("_hit", F.lit(1)), "key", "left")
    out = hit.agg(F.count("_hit").alias("refs"), F.count("*").alias("all_refs"), F.countDistinct(F.when(F.col("_hit") == 1, F.col("file"))).alias("files"), F.countDistinct("file").alias("all_files"))
    return out.withColumn("full", (F.col("refs") > F.greatest(F.lit(5000.0), F.col("all_refs") * 0.1)) | (F.col("files") > F.col("all_files") / 2))


def republished(old: DataFrame, new: DataFrame, key: str, digest: str, generation: int) -> DataFrame:
    """Rows of the next generation: untouched ones keep their generation, removed ones go."""
    o = old.select(key, F.col(digest).alias("_old"), F.col("generation").alias("_g"))
    n = new.join(o, key, "left")
    same = F.col("_old").eqNullSafe(F.col(digest)) & F.col("_g").isNotNull()
    return n.select(*new.columns, F.when(same, F.col("_g")).otherwise(F.lit(generation)).alias("generation"))


def merged_edges(evidence: DataFrame) -> DataFrame:
    """Edges from their evidence: best confidence, shortest ``chain`` (an array), all files in order, number of rows."""
    shortest = F.min(F.struct(F.size("chain"), F.col("chain").alias("chain")))["chain"]
    return evidence.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), shortest.alias("chain"), F.array_sort(F.collect_set("file")).alias("files"), F.count("*").alias("n"))


def conflicts(interceptors: DataFrame) -> DataFrame:
    """Targets that two or more extensions replace: ``target``, ``extensions``, ``confidence`` 0.5."""
    d = interceptors.where("mode = 'instead'").groupBy("target").agg(F.countDistinct("extension").alias("extensions"))
    return d.where("extensions >= 2").withColumn("confidence", F.lit(0.5))


def retrieval_metrics(ranked: DataFrame, cuts: tuple[int, ...] = (1, 3, 10, 20, 50)) -> DataFrame:
    """Per ``section``: queries, hits at each cut, mean reciprocal rank and median rank (``rank`` null: not found)."""
    hits = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits{k}") for k in cuts]
    return ranked.groupBy("section").agg(F.count("*").alias("n"), *hits, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 9).alias("mrr"), F.percentile("rank", 0.5).alias("median"))
