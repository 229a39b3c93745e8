"""Bounded walks over edge tables, one set-based step per level.

Edges are written once and read by every level. A level joins the frontier with them and drops
nodes that were reached before; what it finds is written as a table of its own, so nothing is
computed or copied twice. A frontier whose counted rows are few is broadcast, so a walk from a few
nodes moves no edges. The driver only counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import SMALL, kept, parted, side

#: Rows that one task sorts or groups in a walk over a whole table.
ROWS = 500_000


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def reach(edges: DataFrame, start: DataFrame, depth: int, node_cap: int | None = None) -> DataFrame:
    """``id``, ``depth`` of nodes within ``depth`` steps along ``edges`` (src, dst) of ``start`` (id).

    With ``node_cap``, each level admits nodes in order of ``confidence`` (descending) and id
    until the cap is spent; ``edges`` then have that column.
    """
    own = kept(edges.select("src", "dst", *([] if node_cap is None else ["confidence"])))
    levels = [kept(start.select("id").distinct().withColumn("depth", F.lit(0)))]
    n = total = levels[0].count()
    for level in range(1, depth + 1):
        seen = side(_all(levels).select("id"), total)
        step = own.join(side(levels[-1].select(F.col("id").alias("src")), n), "src")
        if node_cap is None:
            found = step.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        else:
            best = step.groupBy(F.col("dst").alias("id")).agg(F.max("confidence").alias("confidence")).join(seen, "id", "left_anti")
            found = best.orderBy(F.desc("confidence"), "id").limit(max(0, node_cap - total)).select("id")
        frontier = kept(found.withColumn("depth", F.lit(level)))
        n = frontier.count()
        if not n:
            break
        levels.append(frontier)
        total += n
    return _all(levels)


def walk(edges: DataFrame, start: list, depth: int, node_cap: int = 500, fan_cap: int = 200) -> DataFrame:
    """``id, depth, rank, path, leaf`` of the nodes that a walk from ``start`` visits.

    ``edges`` have src, dst, an ``order`` that is total among the edges of a node, and ``open``: a
    node reached by an edge that is not open is a leaf. Every node is visited once, by the path
    that comes first in the order of its parent, then of the edge; a node follows its first
    ``fan_cap`` edges, and the walk ends at ``node_cap`` nodes. Ranks are numbered over at most
    ``node_cap`` rows.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    own = kept(edges.select("src", "dst", "order", "open"))
    first = [(x, 0, i + 1, [x], False) for i, x in enumerate(start)]
    levels = [spark.createDataFrame(first, f"id {kind}, depth int, rank int, path array<{kind}>, leaf boolean")]
    total = len(first)
    for level in range(1, depth + 1):
        parents = levels[-1].where("NOT leaf").select(F.col("id").alias("src"), F.col("rank").alias("parent"), "path")
        step = own.join(F.broadcast(parents), "src")  # at most ``node_cap`` rows
        step = step.withColumn("_n", F.row_number().over(W.partitionBy("src").orderBy("order"))).where(F.col("_n") <= fan_cap)
        best = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("parent", "order", "path", "open")).alias("m"))
        fresh = best.join(F.broadcast(_all(levels).select("id")), "id", "left_anti")
        picked = fresh.orderBy("m.parent", "m.order", "id").limit(max(0, node_cap - total))
        rank = (F.row_number().over(W.orderBy("m.parent", "m.order", "id")) + total).cast("int")
        frontier = kept(picked.select("id", F.lit(level).alias("depth"), rank.alias("rank"), F.array_append("m.path", F.col("id")).alias("path"), (~F.col("m.open")).alias("leaf")))
        n = frontier.count()
        if not n:
            break
        levels.append(frontier)
        total += n
    return _all(levels)


def impact(edges: DataFrame, start: list[str], depth: int = 3, budget: int = 500) -> DataFrame:
    """``id, kind, depth, confidence, rank`` of what depends on ``start`` over edges of several kinds.

    ``edges`` have ``to`` (what is used), ``kind``, ``source`` (who uses it), ``confidence`` and
    ``terminal`` (its sources are not followed, as roles). A node is visited once for each kind; a
    chain is as sure as its least sure edge. The budget admits depth by depth, the surest first;
    the rank is by depth, confidence, kind and id, over at most ``budget`` rows.
    """
    spark = edges.sparkSession
    own = kept(edges.groupBy("to", "kind", "source").agg(F.max("confidence").alias("confidence"), F.bool_or("terminal").alias("terminal")))
    frontier = spark.createDataFrame([(x, 1.0) for x in start], "id string, confidence double")
    levels: list[DataFrame] = []
    total = 0
    for level in range(1, depth + 1):
        step = own.join(F.broadcast(frontier.select(F.col("id").alias("to"), F.col("confidence").alias("_sure"))), "to")  # at most ``budget`` rows
        found = step.groupBy(F.col("source").alias("id"), "kind").agg(F.max(F.least("confidence", "_sure")).alias("confidence"), F.bool_or("terminal").alias("terminal"))
        found = found.where(~F.col("id").isin(start))
        if levels:
            found = found.join(F.broadcast(_all(levels).select("id", "kind")), ["id", "kind"], "left_anti")
        found = found.orderBy(F.desc("confidence"), "kind", "id").limit(max(0, budget - total))
        fresh = kept(found.withColumn("depth", F.lit(level)))
        n = fresh.count()
        if not n:
            break
        levels.append(fresh)
        total += n
        frontier = fresh.where("NOT terminal").groupBy("id").agg(F.max("confidence").alias("confidence"))
    if not levels:
        return spark.createDataFrame([], "id string, kind string, depth int, confidence double, rank int")
    order = W.orderBy("depth", F.desc("confidence"), "kind", "id")
    return _all(levels).select("id", "kind", "depth", "confidence", F.row_number().over(order).alias("rank"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of ``edges``, once each, in parts of about ``ROWS``."""
    own = kept(edges.select("src", "dst"))
    both = own.union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return parted(both, "src", 2 * own.count(), ROWS).distinct()


def shortest_path_counts(edges: DataFrame, source: str, depth: int) -> DataFrame:
    """``id``, ``depth`` and the number of shortest paths from ``source`` over undirected edges."""
    return _distances(kept(undirected(edges)), source, depth)


def _distances(both: DataFrame, source: str, depth: int, target: str | None = None) -> DataFrame:
    """Levels around ``source``; with a ``target``, none beyond the one that it is found in."""
    spark = both.sparkSession
    levels = [spark.createDataFrame([(source, 0, 1)], "id string, depth int, paths long")]
    n = total = 1
    edges = both.count()
    for level in range(1, depth + 1):
        if source == target:
            break
        frontier = levels[-1].select(F.col("id").alias("src"), "paths")
        if n > SMALL:  # neither side is small: both are parted by the edges, so that no task sorts more as these grow
            step = parted(both, "src", edges, ROWS).join(parted(frontier, "src", edges, ROWS), "src")
        else:
            step = both.join(side(frontier, n), "src")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        fresh = kept(step.join(side(_all(levels).select("id"), total), "id", "left_anti").select("id", F.lit(level).alias("depth"), "paths"))
        n = fresh.count()
        if not n:
            break
        levels.append(fresh)
        total += n
        if target is not None and not fresh.where(F.col("id") == target).isEmpty():
            break
    return _all(levels)


def shortest_paths(edges: DataFrame, source: str, target: str, depth: int = 4, most: int = 5) -> DataFrame:
    """``n``, ``path``: the first ``most`` of all shortest paths between two nodes over undirected edges.

    Distances from the source come first, up to the target's; paths then grow backwards from the target over nodes
    that are one step nearer. Every such beginning can be completed, so the first ``most`` in order
    are kept at each step and the result is the same as of all paths.
    """
    both = kept(undirected(edges))
    near = kept(_distances(both, source, depth, target).select("id", "depth"))
    found = near.where(F.col("id") == target).select(F.col("id").alias("at"), "depth", F.array("id").alias("path"))
    reached = found.first()
    for _ in range(reached["depth"] if reached else 0):
        step = both.withColumnRenamed("dst", "at").join(F.broadcast(found), "at")  # at most ``most`` rows
        back = near.select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth"))
        step = step.join(back, ["src", "depth"]).select(F.col("src").alias("at"), (F.col("depth") - 1).alias("depth"), F.array_prepend("path", F.col("src")).alias("path"))
        found = kept(step.orderBy(F.reverse("path")).limit(most))
    return found.select(F.row_number().over(W.orderBy(F.reverse("path"))).alias("n"), F.array_join("path", ">").alias("path"))


def radius(edges: DataFrame, start: str, depth: int = 2, node_cap: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes around ``start`` over undirected edges, the edges between them, and why it ends there.

    The last is one row: ``nodes_cut`` (the cap left nodes out) and ``depth_cut`` (visited nodes
    have neighbours beyond).
    """
    both = kept(edges.select("src", "dst", "confidence").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")))
    spark = edges.sparkSession
    levels = [spark.createDataFrame([(start, 0)], "id string, depth int")]
    total, cut = 1, False
    for level in range(1, depth + 1):
        step = both.join(F.broadcast(levels[-1].select(F.col("id").alias("src"))), "src")  # at most ``node_cap`` rows
        best = step.groupBy(F.col("dst").alias("id")).agg(F.max("confidence").alias("confidence")).join(F.broadcast(_all(levels).select("id")), "id", "left_anti")
        best = kept(best.orderBy(F.desc("confidence"), "id").limit(node_cap - total + 1))
        n = best.count()
        cut = cut or n > node_cap - total
        n = min(n, node_cap - total)
        levels.append(kept(best.orderBy(F.desc("confidence"), "id").limit(n).select("id", F.lit(level).alias("depth"))))
        total += n
        if not n:
            break
    nodes = kept(_all(levels))
    ids = nodes.select("id")
    inner = edges.join(F.broadcast(ids.toDF("src")), "src", "left_semi").join(F.broadcast(ids.toDF("dst")), "dst", "left_semi")
    beyond = both.join(F.broadcast(ids.toDF("src")), "src", "left_semi").join(F.broadcast(ids.toDF("dst")), "dst", "left_anti").limit(1)
    why = beyond.agg((F.count("*") > 0).alias("depth_cut")).select(F.lit(cut).alias("nodes_cut"), "depth_cut")
    return nodes, inner.select(edges.columns), why


def widest(edges: DataFrame, start: DataFrame, depth: int, penalty: float = 0.9) -> DataFrame:
    """Best confidence of a chain to each node: the least edge confidence, times ``penalty`` per step.

    A node goes on only when its confidence became strictly better.
    """
    own = kept(edges.select("src", "dst", "confidence"))
    best = kept(start.select("id", F.lit(1.0).alias("confidence")))
    frontier, n = best, best.count()
    for _ in range(depth):
        step = own.join(side(frontier.select(F.col("id").alias("src"), F.col("confidence").alias("_sure")), n), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.least("confidence", "_sure") * penalty).alias("new"))
        both = kept(best.join(step, "id", "full"))
        frontier = both.where("new IS NOT NULL AND (confidence IS NULL OR new > confidence)").select("id", F.col("new").alias("confidence"))
        n = frontier.count()
        best = both.select("id", F.greatest("confidence", "new").alias("confidence"))
    return best


def attribution(accesses: DataFrame, calls: DataFrame, owners: DataFrame, depth: int = 3, hub: int = 200, free_steps: int = 2) -> DataFrame:
    """``owner, register, mode, confidence``: which objects touch which registers through their code.

    ``accesses`` have symbol, register, mode, confidence; ``calls`` caller, callee, confidence;
    ``owners`` symbol, owner. All accesses walk up their callers at once until a symbol that an
    object owns. A chain is as sure as its least sure step, times 0.7 for each symbol that more than
    ``hub`` callers share, times 0.9 for each step beyond ``free_steps``. Chains that meet at a symbol
    with the same register and mode go on as the surest of them, so a level holds at most one row
    for each.
    """
    up = calls.groupBy("caller", "callee").agg(F.max("confidence").alias("_sure"))
    many = up.groupBy("callee").agg((F.count("*") > hub).alias("_hub"))
    up = kept(up.join(many, "callee").withColumnRenamed("callee", "symbol"))
    fan = up.agg(F.count("*") / F.greatest(F.count_distinct("symbol"), F.lit(1))).first()[0] or 1
    owners = owners.where("owner IS NOT NULL")
    state = kept(accesses.groupBy("symbol", "register", "mode").agg(F.max("confidence").alias("confidence")))
    found = []
    for level in range(depth + 1):
        found.append(state.join(owners, "symbol").groupBy("owner", "register", "mode").agg(F.max("confidence").alias("confidence")))
        if level == depth:
            break
        # a level is sized by the rows that it will have, not by those that it is made of
        rows = int(state.count() * fan)
        go = parted(state.join(owners, "symbol", "left_anti"), "symbol", rows, ROWS)
        sure = F.least("confidence", "_sure") * F.when(F.col("_hub"), 0.7).otherwise(1.0) * (0.9 if level + 1 > free_steps else 1.0)
        if level + 1 == depth:  # of the last callers only those that an object owns count, by their owner
            home = up.join(owners.withColumnRenamed("symbol", "caller"), "caller")
            found.append(go.join(parted(home, "symbol", rows, ROWS), "symbol").groupBy("owner", "register", "mode").agg(F.max(sure).alias("confidence")))
            break
        step = go.join(parted(up, "symbol", rows, ROWS), "symbol").select(F.col("caller").alias("symbol"), "register", "mode", sure.alias("confidence"))
        state = kept(parted(step, "symbol", rows, ROWS).groupBy("symbol", "register", "mode").agg(F.max("confidence").alias("confidence")))
    return _all(found).groupBy("owner", "register", "mode").agg(F.max("confidence").alias("confidence"))


def traced_attribution(accesses: DataFrame, calls: DataFrame, owners: DataFrame, node_budget: int = 500, caller_cap: int = 200, hub: int = 200, free_steps: int = 2, most_steps: int = 64) -> DataFrame:
    """``access, owner, confidence, steps, penalised, truncated``: the owners that each access climbs to.

    ``accesses`` have access (a key), symbol and confidence. Every access climbs by itself, all at once: a
    level is a table of (access, symbol). A symbol is climbed again only if the new chain is strictly surer, so rings end. A
    symbol's first ``caller_cap`` callers are followed, and an access that holds ``node_budget`` symbols stops; either
    is no silence: ``truncated`` says that an owner may lie beyond. Confidence falls as in :func:`attribution`,
    and ``penalised`` says that it did so for a hub or for length.
    """
    up = calls.groupBy("caller", "callee").agg(F.max("confidence").alias("_sure"))
    by = W.partitionBy("callee")
    up = up.select("caller", "callee", "_sure", F.row_number().over(by.orderBy("caller")).alias("_k"), F.count("*").over(by).alias("_all")).where(F.col("_k") <= caller_cap)
    up = kept(up.select("caller", "callee", "_sure", (F.col("_all") > hub).alias("_hub"), (F.col("_all") > caller_cap).alias("_cut")))
    frontier = kept(accesses.groupBy("access", "symbol").agg(F.max("confidence").alias("confidence")).withColumn("penalised", F.lit(False)))
    many = kept(up.where("_cut").select(F.col("callee").alias("symbol")).distinct())
    best, hits, cuts = frontier.select("access", "symbol", "confidence"), [], []
    for level in range(1, most_steps + 1):
        at = kept(frontier.join(owners, "symbol", "left"))
        hits.append(at.where("owner IS NOT NULL").select("access", "owner", "confidence", "penalised", F.lit(level - 1).alias("steps")))
        full = kept(best.groupBy("access").agg(F.count("*").alias("n")).where(F.col("n") >= node_budget).select("access"))
        go = at.where("owner IS NULL").drop("owner")
        cuts.append(go.join(full, "access", "left_semi").select("access"))
        go = go.join(full, "access", "left_anti")
        cuts.append(go.join(many, "symbol", "left_semi").select("access"))
        if level == most_steps:  # what this step reaches would not be looked at
            break
        step = go.withColumnRenamed("symbol", "callee").join(up, "callee")
        long = level > free_steps
        sure = F.least("confidence", "_sure") * F.when(F.col("_hub"), 0.7).otherwise(1.0) * (0.9 if long else 1.0)
        new = step.groupBy("access", F.col("caller").alias("symbol")).agg(F.max(F.struct(sure.alias("confidence"), (F.col("penalised") | F.col("_hub") | F.lit(long)).alias("penalised"))).alias("m"))
        new = new.select("access", "symbol", "m.confidence", "m.penalised")
        seen = best.withColumnRenamed("confidence", "_old")
        frontier = kept(new.join(seen, ["access", "symbol"], "left").where("_old IS NULL OR confidence > _old").drop("_old"))
        if frontier.isEmpty():
            break
        best = kept(best.union(frontier.select("access", "symbol", "confidence")).groupBy("access", "symbol").agg(F.max("confidence").alias("confidence")))
    found = _all(hits).groupBy("access", "owner").agg(F.max(F.struct("confidence", (-F.col("steps")).alias("s"), "penalised")).alias("m"))
    cut = _all(cuts).distinct().withColumn("truncated", F.lit(True))
    return found.join(cut, "access", "left").select("access", "owner", "m.confidence", (-F.col("m.s")).alias("steps"), "m.penalised", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``fan_in``, ``fan_out``: one union of both ends and one aggregation."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def first_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
