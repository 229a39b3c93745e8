"""What holds along hierarchies and call graphs: inherited visibility, coverage by reachability.

A hierarchy is resolved by pointer jumping: every node takes over what holds at the node it points
to and points as far as that one does, so rounds grow with the logarithm of the depth. Reachability
is one backward walk for all goals at once, over (goal, node) pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept, side
from .findings import named, union


#: Pairs of a round of a walk, and of all rounds before, that a join may broadcast; rounds may be many.
LEVEL, SEEN = 20_000, 100_000


def inherited(nodes: DataFrame, flags: list[str]) -> DataFrame:
    """``node`` and its ``flags``, each true where it is true at the node or at any one above it.

    ``nodes`` have node, parent (null at the top) and the boolean ``flags``. A parent that is not among the nodes
    counts for nothing; a ring of parents ends once all in it agree.
    """
    state = kept(nodes.select("node", F.col("parent").alias("up"), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags]))
    n = state.count()
    rounds = max(1, n.bit_length())
    for _ in range(rounds):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), *[F.col(f).alias(f"_{f}") for f in flags])
        joined = state.where("up IS NOT NULL").join(side(above, n), "up", "left")
        moved = joined.select("node", F.col("_up").alias("up"), *[(F.col(f) | F.coalesce(f"_{f}", F.lit(False))).alias(f) for f in flags])
        state = kept(state.where("up IS NULL").union(moved))
    return state.select("node", *flags)


def visibility(objects: DataFrame, contents: DataFrame, subsystems: DataFrame, options: DataFrame, grants: DataFrame) -> DataFrame:
    """``rule, object, part``: why objects, or parts of them, can't be seen.

    ``contents`` have subsystem and object; ``subsystems`` subsystem, parent and included; ``options``
    kind (object, subsystem, part), target, part and enabled: what several options switch is off when all are off;
    ``grants`` object and value. A placement counts only if its section and all above are
    included in the interface, and are not switched off.
    """
    off = options.groupBy("kind", "target", "part").agg(F.bool_or("enabled").alias("on")).where("NOT on")
    shut = off.where("kind = 'subsystem'").select(F.col("target").alias("node"), F.lit(True).alias("shut"))
    nodes = subsystems.select(F.col("subsystem").alias("node"), "parent", (~F.col("included")).alias("hidden")).join(shut, "node", "left")
    state = inherited(nodes, ["hidden", "shut"]).withColumnRenamed("node", "subsystem")
    placed = kept(contents.join(state, "subsystem").groupBy("object").agg(F.bool_and("hidden").alias("hidden"), F.bool_and(F.col("hidden") | F.col("shut")).alias("gone"), F.bool_or(F.col("shut") & ~F.col("hidden")).alias("shut")))
    seen = objects.join(placed, "object", "left_semi")
    of = lambda rule, df: named(rule, df.withColumn("part", F.lit("")), "object", "part")
    whole = off.where("kind = 'object'").select(F.col("target").alias("object"))
    parts = off.where("kind = 'part'").select(F.col("target").alias("object"), "part")
    return union(
        of("NotInAnySubsystem", objects.join(placed, "object", "left_anti")),
        of("NotInCommandInterface", seen.join(placed.where("hidden"), "object", "left_semi")),
        of("SectionHidden", seen.join(placed.where("gone AND shut"), "object", "left_semi")),
        of("HiddenByFunctionalOption", objects.join(whole, "object", "left_semi")),
        named("PartHidden", parts.join(objects, "object", "left_semi"), "object", "part"),
        of("NoRoleGrantsRights", objects.join(grants.where("value").select("object").distinct(), "object", "left_anti")),
    )


def reaching(calls: DataFrame, goals: DataFrame) -> DataFrame:
    """``goal``, ``node``: the nodes from which a goal is reached along ``calls`` (src, dst), its own node included.

    ``goals`` have goal and node. One backward walk for all goals; it ends when no pair is new.
    """
    back = kept(calls.select(F.col("dst").alias("node"), F.col("src").alias("from")).distinct())
    levels = [kept(goals.select("goal", "node").distinct())]
    n = levels[0].count()
    total = n
    while n:
        # what was seen grows with every round, so much of it is not sent whole to all
        step = back.join(F.broadcast(levels[-1]) if n <= LEVEL else levels[-1].hint("merge"), "node").select("goal", F.col("from").alias("node")).distinct()
        seen = reduce(DataFrame.union, levels)
        levels.append(kept(step.join(F.broadcast(seen) if total <= SEEN else seen.hint("merge"), ["goal", "node"], "left_anti")))
        n = levels[-1].count()
        total += n
    return reduce(DataFrame.union, levels)


def exchange_coverage(content: DataFrame, handlers: DataFrame, calls: DataFrame, registrations: DataFrame) -> DataFrame:
    """``plan, object, automatic, handlers, reaching, status`` of every object of every plan.

    ``content`` have plan, object and automatic; ``handlers`` object and node; ``registrations`` plan and
    node. An object that is not registered automatically is covered if one of its handlers reaches a
    registration for the plan; with automatic registration as well it is registered twice.
    """
    reach = reaching(calls, registrations.withColumnRenamed("plan", "goal")).withColumnRenamed("goal", "plan")
    own = content.join(handlers, "object", "left").join(reach.withColumn("hit", F.lit(True)), ["plan", "node"], "left")
    found = own.groupBy("plan", "object", "automatic").agg(F.count_distinct("node").alias("handlers"), F.count_distinct(F.when(F.col("hit"), F.col("node"))).alias("reaching"))
    status = F.when(F.col("automatic") & (F.col("reaching") > 0), "twice").when(F.col("automatic"), "automatic").when(F.col("reaching") > 0, "manual").otherwise("uncovered")
    return found.withColumn("status", status)
