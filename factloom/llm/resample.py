"""Importance resampling of documents towards a target distribution.

Words are laid out by position (posexplode); for runs of more than one word a window per document
puts the following words beside each (lead), and every order's run is one feature. A feature
falls into one of ``BUCKETS`` buckets by its checksum. Buckets are counted over all documents and
over all target texts; the gain of a bucket is the scaled logarithm of the ratio of its smoothed
shares, and a document weighs what its features gain. Gumbel noise from a hash of the id turns
the highest scores into a sample drawn without replacement in proportion to exp(weight / 1000).

Nothing but counts moves: features are counted within tasks before they are shuffled, the table
of gains has ``BUCKETS`` rows whatever the input is and so may be broadcast, and only slim rows of
numbers are sorted to rank them, over all tasks; a partition's rank begins where the one before
ends, which takes one number a partition.

Defined cases: null and empty texts, and texts without words, have no features and weight 0 and
are not drawn by the registered query, which asks for 20 words; a null ``doc_id`` is hashed as an
empty one and comes last among equal scores; repeated rows are documents of their own, drawn one
by one; empty documents give an empty result, an empty target gives gains against nothing but the
smoothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

BUCKETS = 10_000
#: Characters of words once A-Z are lower-cased: digits, a-z and all beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def features(docs: DataFrame, orders: int = 1) -> DataFrame:
    """``row``, ``doc_id``, ``pos`` and ``bucket`` of each run of 1 to ``orders`` words.

    A document without words keeps one row, whose ``pos`` and ``bucket`` are null.
    """
    table = docs.select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    bucket = lambda run: F.crc32(F.encode(run, "UTF-8")) % BUCKETS
    if orders == 1:
        return table.select("row", "doc_id", "pos", bucket(F.col("word")).cast("int").alias("bucket"))
    window = W.partitionBy("row").orderBy("pos")
    following = [F.lead("word", k).over(window).alias(f"w{k}") for k in range(1, orders)]
    table = table.select("row", "doc_id", "pos", F.col("word").alias("w0"), *following)
    runs = F.array(*[F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *[f"w{i}" for i in range(k + 1)])) for k in range(orders)])
    each = table.select("row", "doc_id", "pos", F.explode(F.when(F.col("w0").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.filter(runs, lambda x: x.isNotNull()))).alias("run"))
    return each.select("row", "doc_id", "pos", bucket(F.col("run")).cast("int").alias("bucket"))


def _counts(docs: DataFrame, orders: int, name: str) -> DataFrame:
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("doc_id"), "text")
    return features(numbered, orders).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1) -> DataFrame:
    """``bucket`` and whole-number ``gain`` of every bucket (``BUCKETS`` rows)."""
    spark = docs.sparkSession
    both = saved(spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(_counts(docs, orders, "s"), "bucket", "left").join(_counts(target, orders, "t"), "bucket", "left").na.fill(0, ["s", "t"]))
    s_all, t_all = both.agg(F.sum("s"), F.sum("t")).first()
    number = lambda c: F.col(c).cast("double") + 1.0
    ratio = (number("t") * F.lit(float(s_all + BUCKETS))) / (number("s") * F.lit(float(t_all + BUCKETS)))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, orders: int = 1, seed: str = "2024") -> DataFrame:
    """``row``, ``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # BUCKETS rows of two numbers, whatever the input
    table = F.broadcast(saved(gains(docs, target, orders)))
    each = features(numbered, orders).join(table, "bucket", "left")
    summed = each.groupBy("row", "doc_id").agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("long").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in ``order``, sorted by ranges and numbered without one task for all."""
    n = F.monotonically_increasing_id()
    placed = saved(rows.orderBy(*order).select("*", F.shiftright(n, 33).alias("_part"), n.bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, orders: int = 1, seed: str = "2024") -> DataFrame:
    """Every document's ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with ``least_words`` words or more the ``percent`` with the highest scores
    (rounded down) are drawn and ranked; the others' rank is null.
    """
    scored = saved(weighed(docs, target, orders, seed))
    long_enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight"), F.col("row")]
    wanted = scored.where(long_enough).count() * percent // 100
    inside = ranked(scored.where(long_enough), order).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return inside.select(columns).union(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")).select(columns))
