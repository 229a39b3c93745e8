"""Mixing sources to target weights as a curriculum that changes over training time.

Every source has a weight schedule over training time t in [0, 1], linear from ``start`` to
``end``; its integral is the source's cumulative token demand. A document stands in its source's
stream after the tokens before it, so the time at which the demand reaches that share is the
inverse of the integral, in closed form for a linear schedule. Documents are range-sorted by
that time. How much of a source is taken follows from the cumulative target in the same stream:
each document takes the difference of the cumulative target after and before it, rounded down in
whole-number arithmetic, so a source's words sum to its target to within one word and a document
never gives more than ``repeats`` times its size.

Everything is DataFrame functions. A source's running total is made in two steps: sums per
(source, slice) give each slice's offset, and only rows of one slice are summed in order, so a
source with a third of all rows is spread over 4096 windows.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own,
last in order; repeated rows each have a place in the stream; an empty table gives an empty
result; a null doc_id is placed by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD, saved

#: Hex digits of a document's place that name its slice: 4096 slices of every source, each
#: summed as one window. Raise it with the documents of a source.
DIGITS = 3
#: A source's words may be taken this many times.
REPEATS = 3


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``source``, ``more``, ``size`` (the number of words) and ``place`` of every document.

    The place is a hash of the id and the text's length and beginning, so rows that share an id,
    or have none, still spread over all slices.
    """
    place = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.length("text").cast("string"), F.left("text", F.lit(64))))
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("place"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` words of each source.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``repeats``
    times the source's size and the excess is shared by weight among the others. Sorted by
    size per weight, the sources that stop form a prefix, so the level at which the others
    share the rest is a running sum. The table has one row per source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = total.withColumn("ordinal", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    total = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("ordinal") - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = W.partitionBy()
    order = W.orderBy(F.col("source_size") * repeats / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(float(repeats))
    level = total.withColumn("limit", limit).withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = level.withColumn("free", F.col("rest") * F.col("weight") < F.col("limit") * F.col("left"))
    # the level of the first source that does not stop holds for all after it
    level = level.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), (F.col("rest") / F.col("left")).alias("v")))).over(everything)["v"])
    return level.select("source", "ordinal", "source_size", "weight", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), "limit").alias("target"))


def time_of(share: str, weight: str = "weight") -> str:
    """The time at which a source's cumulative demand reaches a share of its target.

    Light sources start high and fade, heavy ones grow; the slope is bounded so that the weight
    stays positive.
    """
    w = f"greatest(1.0D, least(3.0D, {weight}))"
    a, b = f"(1.5D - 0.25D * {w})", f"(0.5D * {w} - 1.0D)"
    return f"CASE WHEN abs({b}) < 1e-9 THEN {share} / {a} ELSE (sqrt({a} * {a} + 2.0D * {b} * {share}) - {a}) / {b} END"


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Per document: size, source_size, target, taken words and the training ``position`` in [0, 1).

    Rows come range-sorted by position. Schedules are ``a + b t`` with integral ``a + b / 2`` = 1,
    so the demand is ``a t + b t^2 / 2`` and the time of share ``u`` is
    ``(sqrt(a^2 + 2 b u) - a) / b`` (``u / a`` for b = 0).
    """
    sized = saved(sizes(docs))
    plan = saved(targets(sized, weights, repeats).withColumnRenamed("source", "s"))
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("slice", F.substring("place", 1, DIGITS))
    sums = placed.groupBy("ordinal", "slice").agg(F.sum("size").alias("words"))
    offset = sums.select("ordinal", "slice", (F.sum("words").over(W.partitionBy("ordinal").orderBy("slice")) - F.col("words")).alias("offset"))
    stream = W.partitionBy("ordinal", "slice").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = placed.withColumn("run", F.sum("size").over(stream)).join(offset, ["ordinal", "slice"]).withColumn("after", F.col("offset") + F.col("run"))
    share = "CAST({} AS DECIMAL(19, 0)) * CAST(floor(target) AS DECIMAL(19, 0)) div source_size"  # whole numbers: no rounding at any size
    rows = rows.withColumn("taken", F.expr(f"CASE WHEN source_size > 0 THEN {share.format('after')} - {share.format('(after - size)')} ELSE 0L END"))
    rows = rows.withColumn("position", F.expr(f"CASE WHEN source_size = 0 THEN 0.0D ELSE {time_of('((after - size / 2) / source_size)')} END"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix in training order, as often as it takes them, in their own columns.

    A source's documents, the longest first, take the difference of the rounded cumulative share
    r = target / source size after and before each: floor(r) or one more whole copies. Sizes fall
    along that order, so the words taken miss the target by at most half of the longest document.
    Every copy stands in its source's stream after the tokens taken before it, first copies before
    second ones, and its time is the inverse of the cumulative demand as in ``mix``. Ties of the
    id are broken by the text, then by the row.
    """
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()))
    sized = sizes(rows, "_row").drop("doc_id")
    sized = saved(sized.withColumn("slice", F.substring("place", 1, DIGITS)))
    plan = targets(sized, weights, repeats)
    plan = saved(plan.select(F.col("source").alias("s"), "ordinal", F.expr("CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0D END").alias("share"), "weight"))
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("source", "s")
    # ranks by size, then place: documents before the size, before the slice and within both
    counts = saved(placed.groupBy("ordinal", "size", "slice").count())
    same = counts.groupBy("ordinal", "size").agg(F.sum("count").alias("n"))
    longer = same.select("ordinal", "size", (F.sum("n").over(W.partitionBy("ordinal").orderBy(F.desc("size"))) - F.col("n")).alias("longer"))
    before = counts.withColumn("before", F.sum("count").over(W.partitionBy("ordinal", "size").orderBy("slice")) - F.col("count")).drop("count").join(longer, ["ordinal", "size"])
    within = F.row_number().over(W.partitionBy("ordinal", "size", "slice").orderBy("place", "_row"))
    ranked = placed.join(before, ["ordinal", "size", "slice"]).withColumn("rank", F.col("longer") + F.col("before") + within)
    taken = ranked.withColumn("copies", F.expr("CAST(floor(rank * share + 0.5D) - floor((rank - 1) * share + 0.5D) AS INT)")).where("copies > 0")
    taken = saved(taken.select("_row", "ordinal", "weight", "size", "slice", "place", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch")))
    # tokens taken before every copy: before the epoch and slice, and within both
    sums = taken.groupBy("ordinal", "epoch", "slice").agg(F.sum("size").alias("words"))
    source = W.partitionBy("ordinal")
    offset = sums.select("ordinal", "epoch", "slice", F.sum("words").over(source).alias("total"), (F.sum("words").over(source.orderBy("epoch", "slice")) - F.col("words")).alias("offset"))
    stream = W.partitionBy("ordinal", "epoch", "slice").orderBy("place", "_row").rowsBetween(W.unboundedPreceding, 0)
    run = taken.withColumn("run", F.sum("size").over(stream)).join(offset, ["ordinal", "epoch", "slice"])
    share = "((offset + run - size / 2) / total)"
    order = saved(run.select("_row", F.expr(f"CASE WHEN total = 0 THEN 0.0D ELSE {time_of(share)} END").alias("_position")))
    # few copies are broadcast, so that texts are shuffled once; beyond that both sides are
    found = rows.join(F.broadcast(order) if order.count() <= BROADCAST_IDS else order, "_row")
    return found.orderBy("_position", "doc_id", "_row").select(docs.columns)
