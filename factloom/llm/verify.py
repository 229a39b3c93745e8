"""Verification of candidate pairs by their sets: in stars around one set, and in cells of groups.

Sets are sorted arrays of 64-bit numbers. Only who is connected counts here: stars are compared at a
cost in proportion to them, and of a group in which much is tied already only what is still apart is
compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, released, saved
from .lines import _roots, _stream

#: Members that one task compares with a set at most.
STAR = 4_096
#: Parts into which the suffix filter cuts a set.
PARTS = 16
#: Shingles of a group that are compared in one piece, and those that are compared at once.
CELL_SHINGLES, WIDTH = 1 << 19, 1_024


def with_few(df: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """A join with a saved table that is broadcast if its counted rows are few."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_IDS // 4 else table.hint("merge"), on, how)


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The ``pairs`` (distinct ``a``, ``b``) whose sets match.

    Pairs are gathered by ``a``, whose set is sent once for each ``STAR`` of them and held while the
    others pass by. ``sets`` gives the sets of a table of ids; they go from where their texts are read
    to where they are compared, in one shuffle.
    """
    many = saved(pairs.groupBy("a").count().withColumn("salts", F.ceil(F.col("count") / STAR).cast("int")).select("a", "salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int").alias("salt")
    others = with_few(pairs, saved(many.where("salts > 1")), "a").select(F.col("b").alias("id"), "a", salt, "b")
    held = many.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    roles = saved(held.union(others))
    found = with_few(sets(roles.select("id").distinct()), roles, "id", "inner").select("a", "salt", "b", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, edges, own_set = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            a_all, s_all = batch["a"].to_pylist(), batch["s"]
            for i, (a, b) in enumerate(zip(a_all, batch["b"].to_pylist())):
                s = np.frombuffer(s_all[i].as_buffer(), np.uint64)
                if b is None:
                    own, own_set = a, s.copy()
                    edges = np.linspace(0, len(s), PARTS + 1).astype(np.int64)
                    continue
                both = len(s) + len(own_set)
                most = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9)  # what they may differ in
                # suffix filter: pivots of the one set cut the other; parts of unlike sizes differ at least by that
                cuts = np.append(np.append(0, np.searchsorted(s, own_set[edges[1:-1]])), len(s))
                if a != own or np.abs(np.diff(cuts) - np.diff(edges)).sum() > most:
                    continue
                at = np.searchsorted(own_set, s)
                common = int((own_set[np.minimum(at, len(own_set) - 1)] == s).sum())
                if common >= similarity * (both - common) - 1e-9:
                    found.append((a, b))
            if found:
                a, b = zip(*found)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return found.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(released(run), "a long, b long")


def cells(rows: DataFrame, key: str, cell: int, shingles: int | None = None) -> DataFrame:
    """``rows`` (``key``, ``id``, ``own``, ``n`` and others) with the cell ``g`` in which their pairs meet.

    All pairs of one key and different ``own`` meet in some cell of about ``cell`` rows, or of
    ``shingles`` n-grams, or a little more. Of a large key the largest ``own`` is dealt into blocks that
    its rows never leave; the other rows go to all of these blocks and to the blocks of each other.
    """
    weight = lambda m, n: F.ceil(F.greatest(m * 2 / cell, n * 2 / shingles if shingles else F.lit(0.0))).cast("int")
    parts = rows.groupBy(key, "own").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    base = parts.groupBy(key).agg(F.max_by(F.struct("own", "m", "w"), F.struct("m", "own")).alias("b"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    base = base.where((F.col("m") > cell) | (F.col("w") > shingles if shingles else F.lit(False)))
    base = saved(base.select(key, F.col("b.own").alias("base"), F.greatest(F.lit(1), weight(F.col("b.m"), F.col("b.w"))).alias("wide"), F.greatest(F.lit(1), weight(F.col("m") - F.col("b.m"), F.col("w") - F.col("b.w"))).alias("rest")))
    placed = with_few(rows, base, key)
    in_base = F.col("own") == F.col("base")
    block = F.pmod(F.xxhash64("id"), F.when(in_base, F.col("wide")).otherwise(F.col("rest"))).cast("int")
    each = lambda c, f: F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)
    at = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    others = F.concat(each("wide", lambda b: at(0, b, block)), each("rest", lambda j: at(1, F.least(j, block), F.greatest(j, block))))
    own_cells = F.when(F.col("base").isNull(), F.array(at(2, F.lit(0), F.lit(0)))).when(in_base, each("rest", lambda j: at(0, block, j))).otherwise(others)
    dealt = placed.withColumn("c", F.explode(own_cells))
    # a cell is a key like any other: were two equal, pairs would be added and none lost
    return dealt.withColumn("g", F.when(F.col("c.side") == 2, F.col(key)).otherwise(F.xxhash64(key, "c"))).drop("c", "base", "wide", "rest")


def within(groups: DataFrame, sets: Callable[[DataFrame], DataFrame], labels: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Edges that tie all matching classes of each group of dense candidates (``id``, ``component``)."""
    own_sets = sets(groups.select("id")).dropDuplicates(["id"])
    found = groups.join(own_sets, "id").join(labels.withColumnRenamed("component", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
    placed = cells(saved(found.select("component", "id", "own", "n", "s")), "component", cell, CELL_SHINGLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _stream(batches, ["g"]):
            g, ids, sets = pdf["g"].to_numpy(), pdf["id"].to_numpy(), pdf["s"].tolist()
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            for a, b in zip(first.tolist(), np.append(first[1:], len(g)).tolist()):
                if b - a > 1:
                    root = similar_roots([np.frombuffer(x, np.uint64) for x in sets[a:b]], similarity)
                    other = np.flatnonzero(root != np.arange(b - a))
                    yield pd.DataFrame({"a": ids[a + root[other]], "b": ids[a + other]})

    return placed.select("g", "id", "s").repartition("g").sortWithinPartitions("g", "id").mapInPandas(released(run), "a long, b long")


def similar_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """First member that each set is tied to by pairs of Jaccard similarity ``similarity`` or more."""
    n = np.array([len(s) for s in sets])
    vocabulary, number = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(number)
    column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[number]  # shingles of one set are common to no pair
    row = np.repeat(np.arange(len(sets)), n)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, (k, k + WIDTH))
        table = np.zeros((len(sets), min(WIDTH, int(column[b - 1]) + 1 - k)), np.float32)
        table[row[a:b], column[a:b] - k] = 1
        common += table @ table.T
    pairs = [np.zeros((0, 2), np.int64)]
    for i in range(len(sets) - 1):
        both = common[i, i + 1 :].astype(np.float64)
        j = np.flatnonzero(both >= similarity * (n[i] + n[i + 1 :] - both))
        pairs.append(np.stack([np.full(len(j), i), i + 1 + j], 1))
    return _roots(len(sets), np.concatenate(pairs))
