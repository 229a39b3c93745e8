"""Registered queries: visibility through nested sections and exchange coverage by reachability, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy
from ..sources import facts
from ..sources import tables as t
from .lookups import fact_query
from .queries import query


def _subsystems(s, d):
    """Suppliers as a tree of sections, three below each."""
    k = F.col("s_suppkey")
    return t.table(s, d, "supplier").select(k.alias("subsystem"), F.when(k > 0, F.floor((k - 1) / 3)).cast("long").alias("parent"), (F.col("s_acctbal") > -300).alias("included"))


@query("""WITH RECURSIVE sub AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 3 END AS parent, s_acctbal <= -300 AS hidden, s_acctbal > 9000 AND s_nationkey % 2 = 1 AS shut FROM supplier),
w(node, hidden, shut) AS (SELECT node, hidden, shut FROM sub WHERE parent IS NULL OR parent NOT IN (SELECT node FROM sub) UNION ALL SELECT s.node, w.hidden OR s.hidden, w.shut OR s.shut FROM w JOIN sub s ON s.parent = w.node) SELECT node AS subsystem, hidden, shut FROM w""")
def section_states(s, d):
    """Whether each section is hidden or switched off, by itself or by one above it."""
    off = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("subsystem"), ((F.col("s_acctbal") > 9000) & (F.col("s_nationkey") % 2 == 1)).alias("shut"))
    nodes = _subsystems(s, d).join(off, "subsystem").select(F.col("subsystem").alias("node"), "parent", (~F.col("included")).alias("hidden"), "shut")
    return hierarchy.inherited(nodes, ["hidden", "shut"]).withColumnRenamed("node", "subsystem")


@query("""WITH RECURSIVE sub AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 3 END AS parent, s_acctbal <= -300 AS hidden, s_acctbal > 9000 AND s_nationkey % 2 = 1 AS shut FROM supplier),
w(node, hidden, shut) AS (SELECT node, hidden, shut FROM sub WHERE parent IS NULL OR parent NOT IN (SELECT node FROM sub) UNION ALL SELECT s.node, w.hidden OR s.hidden, w.shut OR s.shut FROM w JOIN sub s ON s.parent = w.node),
contents AS (SELECT DISTINCT l_suppkey AS subsystem, l_partkey AS object FROM lineitem WHERE l_quantity > 48),
placed AS (SELECT object, bool_and(hidden) AS hidden, bool_and(hidden OR shut) AS gone, bool_or(shut AND NOT hidden) AS shut FROM contents JOIN w ON w.node = subsystem GROUP BY 1), objects AS (SELECT p_partkey AS object, p_brand, p_size FROM part),
parts AS (SELECT l_partkey AS object, 'part ' || l_returnflag AS part FROM lineitem WHERE l_tax = 0 GROUP BY 1, 2 HAVING NOT bool_or(l_linestatus = 'F'))
SELECT 'NotInAnySubsystem' AS rule, object, '' AS part FROM objects WHERE object NOT IN (SELECT object FROM placed) UNION ALL SELECT 'NotInCommandInterface', object, '' FROM objects JOIN placed USING (object) WHERE hidden UNION ALL SELECT 'SectionHidden', object, '' FROM objects JOIN placed USING (object) WHERE gone AND shut
UNION ALL SELECT 'HiddenByFunctionalOption', object, '' FROM objects WHERE p_size < 5 AND p_brand < 'Brand#2' UNION ALL SELECT 'PartHidden', object, part FROM parts WHERE object IN (SELECT object FROM objects) UNION ALL SELECT 'NoRoleGrantsRights', object, '' FROM objects WHERE object NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)""")
def nested_visibility(s, d):
    """Why objects and their parts can't be seen, through sections within sections."""
    p, li, sup = t.table(s, d, "part"), t.table(s, d, "lineitem"), t.table(s, d, "supplier")
    row = lambda df, kind, target, part, on: df.select(F.lit(kind).alias("kind"), F.col(target).alias("target"), part.alias("part"), on.alias("enabled"))
    options = row(sup.where("s_acctbal > 9000"), "subsystem", "s_suppkey", F.lit(""), F.col("s_nationkey") % 2 == 0)
    options = options.union(row(p.where("p_size < 5"), "object", "p_partkey", F.lit(""), F.col("p_brand") >= "Brand#2"))
    options = options.union(row(li.where("l_tax = 0"), "part", "l_partkey", F.concat(F.lit("part "), "l_returnflag"), F.col("l_linestatus") == "F"))
    contents = li.where("l_quantity > 48").select(F.col("l_suppkey").alias("subsystem"), F.col("l_partkey").alias("object")).distinct()
    grants = li.select(F.col("l_partkey").alias("object"), (F.col("l_discount") > 0.09).alias("value"))
    return hierarchy.visibility(p.select(F.col("p_partkey").alias("object")), contents, _subsystems(s, d), options, grants)


@fact_query("""WITH RECURSIVE edges AS (SELECT DISTINCT caller AS src, callee AS dst FROM calls WHERE kind = 'R' AND resolution = 'resolved' AND confidence > 0.95), goals AS (SELECT r_regionkey AS plan, symbol AS node FROM symbols JOIN region ON symbol % 50 = r_regionkey),
reach(plan, node) AS (SELECT plan, node FROM goals UNION SELECT r.plan, e.src FROM reach r JOIN edges e ON e.dst = r.node),
content AS (SELECT n_regionkey AS plan, m.module AS object, m.module % 4 = 0 AS automatic FROM modules m JOIN nation ON n_nationkey = m.module % 25), handlers AS (SELECT module AS object, symbol AS node FROM symbols WHERE exported)
SELECT c.plan, c.object, automatic, count(DISTINCT h.node) AS handlers, count(DISTINCT r.node) AS reaching, CASE WHEN automatic AND count(DISTINCT r.node) > 0 THEN 'twice' WHEN automatic THEN 'automatic' WHEN count(DISTINCT r.node) > 0 THEN 'manual' ELSE 'uncovered' END AS status
FROM content c LEFT JOIN handlers h ON h.object = c.object LEFT JOIN reach r ON r.plan = c.plan AND r.node = h.node GROUP BY 1, 2, 3""")
def exchange_coverage(s, d):
    """Which objects of each exchange plan are registered, automatically or by a handler that reaches it."""
    calls = facts.calls(s, d).where("kind = 'R' AND resolution = 'resolved' AND confidence > 0.95").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    sy, n = facts.symbols(s, d), t.table(s, d, "nation")
    goals = sy.join(t.table(s, d, "region"), F.col("symbol") % 50 == F.col("r_regionkey")).select(F.col("r_regionkey").alias("plan"), F.col("symbol").alias("node"))
    content = facts.modules(s, d).join(n, F.col("module") % 25 == F.col("n_nationkey")).select(F.col("n_regionkey").alias("plan"), F.col("module").alias("object"), (F.col("module") % 4 == 0).alias("automatic"))
    return hierarchy.exchange_coverage(content, sy.where("exported").select(F.col("module").alias("object"), F.col("symbol").alias("node")), calls, goals)
