"""Sharding by sampled splitters.

Keys are (text hash, doc_id, row number). Each record enters the sample with a probability in proportion to
its share of the bytes and of the rows, the sample's quantiles become the boundaries of many
fine ranges, every record goes to its range, and ranges that turn out overfull are subdivided by
samples of their own until no new boundary is found. The exact bytes of all ranges then decide where shards begin, so shard
sizes are near equal whatever the sample missed. Equal texts have neighbouring keys: a group of
copies stays in one range and one shard unless the group alone is overfull, and then it is
divided by ``doc_id``, and rows that repeat text and ``doc_id`` by their number.

Only the sample (about ``SAMPLE`` keys, whatever the input's size) and one row per range reach
the driver.

Defined cases: a null text has size 1 and the checksum of the empty text; a null doc_id sorts
first; any number of rows may repeat the same text and doc_id, their numbers part them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

SAMPLE = 65_536
RANGES = 4_096
#: A group of equal texts may be divided if it fills more than this part of a shard.
WHOLE = 0.01
LEAST = -(1 << 63)
#: Bits of a hash by which rows meet the ranges.
BITS = 13


def keys(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, the text's ``hash`` and the row's number ``tie``: all that sharding needs of a record.

    The number is ``tie`` of ``docs`` if they have it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.col("_tie") if "_tie" in docs.columns else F.monotonically_increasing_id()
    return docs.select("doc_id", tie.alias("tie"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("hash"))


def _sample(rows: DataFrame, size: int, rows_n: int, wanted: int, draw: int = 0) -> pd.DataFrame:
    """About ``wanted`` keys, drawn by size and row, with the weight that each stands for.

    Every ``draw`` is a fresh one.
    """
    share = F.col("size") * (0.5 / max(size, 1)) + 0.5 / max(rows_n, 1)
    u = F.pmod(F.xxhash64("hash", "doc_id", "tie", F.lit(f"sample {draw}")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.withColumn("p", share * wanted).where(u < F.col("p"))
    return drawn.select("hash", F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "tie", F.greatest(F.lit(1.0), "p").alias("weight")).toPandas()


def _splitters(sample: pd.DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Keys that cut the sample into ``parts`` of equal weight.

    Cuts that fall into one text's keys once are moved to its first key, so that its copies stay
    together, and those that fall into the rows of one text and id once to the first of these.
    """
    if sample.empty or parts < 2:
        return []
    s = sample.sort_values(["hash", "doc_id", "tie"], kind="stable")
    up = s["weight"].cumsum().to_numpy()
    at = np.unique(np.minimum(np.searchsorted(up, up[-1] * np.arange(1, parts) / parts), len(s) - 1))
    cuts = list(zip(*(s[c].to_numpy()[at].tolist() for c in ("hash", "doc_id", "tie"))))
    texts, rows = Counter(h for h, _, _ in cuts), Counter((h, d) for h, d, _ in cuts)
    own = [(h, d, t) if rows[h, d] > 1 else (h, d, LEAST) for h, d, t in cuts if texts[h] > 1]
    return sorted({(h, LEAST, LEAST) for h, _, _ in cuts} | {(h, d, LEAST) for h, d, _ in own} | set(own))


def _ranged(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` with the ``range`` of their key: the number of splitters up to it.

    Ranges are a table that rows meet by the first bits of their hash, so rows with their texts stay in Spark:
    where a range covers these bits alone there is nothing to compare, else its first and next key decide.
    """
    spark = rows.sparkSession
    edges = [(LEAST, LEAST, LEAST), *cuts]
    table = spark.createDataFrame([(i, *low, *(high or (None, None, None))) for i, (low, high) in enumerate(zip(edges, [*cuts, None]))], "range int, h0 long, d0 long, t0 long, h1 long, d1 long, t1 long")
    bits = lambda c: F.shiftright(c, 64 - BITS).cast("int")
    table = table.withColumn("_bits", F.explode(F.sequence(bits("h0"), bits(F.coalesce("h1", F.lit((1 << 63) - 1))))))
    h, d, t = F.col("hash"), F.coalesce("doc_id", F.lit(LEAST)), F.col("tie")
    reached = lambda n: (h > F.col(f"h{n}")) | ((h == F.col(f"h{n}")) & ((d > F.col(f"d{n}")) | ((d == F.col(f"d{n}")) & (t >= F.col(f"t{n}")))))
    own = rows.withColumn("_bits", bits("hash"))
    # a few thousand ranges and as many beginnings of a hash, whatever the input: their numbers are parameters
    return own.join(F.broadcast(table), "_bits").where(reached(0) & ~F.coalesce(reached(1), F.lit(False))).drop("_bits", "h0", "d0", "t0", "h1", "d1", "t1")


def _plan(rows: DataFrame, shards: int, sample: int, ranges: int) -> tuple[list[tuple[int, int, int]], pd.DataFrame]:
    """Splitters, and for every range its shard and the rows before it in the shard."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts, draw = _splitters(_sample(rows, total, count, sample), ranges), 0
    while True:  # every round adds splitters, so that ``sums`` are those of the final ranges
        placed = saved(_ranged(rows, cuts))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("range")
        over = sums[(sums["bytes"] > 4 * total / ranges) & (sums["bytes"] > total * WHOLE / shards) & (sums["rows"] > 1)]
        draw += 1
        more = _splitters_within(placed.where(F.col("range").isin(over["range"].tolist())), over, total, ranges, sample, draw) - set(cuts) if len(over) else set()
        if not more:
            break
        cuts = sorted(set(cuts) | more)
    begin = _shard_starts(sums, cuts, shards, total)
    shard = np.searchsorted(np.array(begin[1:], np.int64), sums["range"].to_numpy(), side="right")
    sums = sums.assign(shard=shard)
    return cuts, sums.assign(before=sums.groupby("shard")["rows"].cumsum() - sums["rows"])[["range", "shard", "before"]]


def shard_records(docs: DataFrame, shards: int = 16, sample: int = SAMPLE, ranges: int = RANGES, stored: bool = False) -> DataFrame:
    """The records with ``size``, ``text_crc32``, ``shard`` and ``slot``, sorted by slot within ranges.

    The plan is made from slim keys; the records themselves move once, to their range. They are
    written with their numbers first, so that both mean the same rows, unless ``docs`` are ``stored``:
    rows of files have the same numbers at every reading. Columns of ``docs`` with the names of new
    ones are replaced.
    """
    numbered = docs.withColumn("_tie", F.monotonically_increasing_id())
    numbered = numbered if stored else saved(numbered)
    return _placed(numbered, saved(keys(numbered)), shards, sample, ranges).drop("_tie")


def place(docs: DataFrame, shards: int = 16, sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """Shard and slot of every record without the record: ``doc_id, size, text_crc32, shard, slot``."""
    rows = saved(keys(docs))
    return _placed(rows, rows, shards, sample, ranges).drop("tie")


def _placed(records: DataFrame, rows: DataFrame, shards: int, sample: int, ranges: int) -> DataFrame:
    cuts, where = _plan(rows, shards, sample, ranges)
    if records is not rows:
        text = F.coalesce(F.col("text"), F.lit(""))
        records = records.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")), "hash": F.xxhash64(text), "tie": F.col("_tie")})
    spark = records.sparkSession
    table = spark.createDataFrame(where.astype({"range": "int32", "shard": "int32", "before": "int64"}), "range int, shard int, before long")
    within = F.row_number().over(W.partitionBy("range").orderBy("hash", "doc_id", "tie")) - 1
    # ``table`` has at most a few thousand rows whatever the input: their number is a parameter
    numbered = _ranged(records.drop("shard", "slot", "range", "before", "within"), cuts).withColumn("within", within).join(F.broadcast(table), "range")
    return numbered.withColumn("slot", F.col("before") + F.col("within")).drop("hash", "range", "before", "within", *(["tie"] if records is not rows else []))


def _splitters_within(inner: DataFrame, over: pd.DataFrame, total: int, ranges: int, wanted: int, draw: int) -> set[tuple[int, int, int]]:
    """More splitters for overfull ranges, from a sample of their records alone."""
    size, count = int(over["bytes"].sum()), int(over["rows"].sum())
    sample = _sample(inner, size, count, wanted, draw)
    return set(_splitters(sample, 2 * max(2, int(ranges * size / max(total, 1)))))


def _shard_starts(sums: pd.DataFrame, cuts: list[tuple[int, int, int]], shards: int, total: int) -> list[int]:
    """First range of each shard: where the bytes before it are nearest to its share.

    A range that begins with a text's first key is preferred within ``WHOLE`` of a shard.
    """
    number, up = sums["range"].tolist(), np.concatenate(([0], np.cumsum(sums["bytes"].to_numpy())))
    clean = np.array([r == 0 or cuts[r - 1][1] == LEAST for r in number] + [True])
    starts = [0]
    for k in range(1, shards):
        off = np.abs(up - total * k / shards)
        best = int(np.argmin(off))
        whole = np.where(clean, off, np.inf)
        if whole.min() <= off[best] + total / shards * WHOLE:
            best = int(np.argmin(whole))
        starts.append(number[best] if best < len(number) else (number[-1] + 1 if number else 0))
    return starts
