"""Registered queries: walks, paths, impact, attribution and cards over the fact graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..operators import relational as rel
from ..sources import facts
from ..sources import tables as t
from .lookups import fact_query
from .queries import _EDGES, query

_CALLS = """e AS (SELECT caller AS src, callee AS dst, min(file * 100 + line) AS place, bool_or(resolution = 'resolved') AS open FROM calls GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY place, dst) AS n FROM e)"""


def _call_edges(s, d):
    c = facts.calls(s, d).groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    c = c.agg(F.min(F.col("file") * 100 + F.col("line")).alias("place"), F.bool_or(F.col("resolution") == "resolved").alias("open"))
    return c.select("src", "dst", F.struct("place", "dst").alias("order"), "open")


@fact_query(f"""WITH {_CALLS}, l1 AS (SELECT dst AS id, 1 AS depth, row_number() OVER (ORDER BY place, dst) + 1 AS rank, '7>' || dst AS path, NOT open AS leaf FROM f WHERE src = 7 AND n <= 200 AND dst <> 7),
b AS (SELECT f.dst AS id, p.rank AS parent, f.place, p.path || '>' || f.dst AS path, NOT f.open AS leaf FROM f JOIN l1 p ON f.src = p.id WHERE NOT p.leaf AND n <= 200 AND f.dst <> 7 AND f.dst NOT IN (SELECT id FROM l1) QUALIFY row_number() OVER (PARTITION BY f.dst ORDER BY p.rank, f.place) = 1),
l2 AS (SELECT id, 2 AS depth, row_number() OVER (ORDER BY parent, place, id) + 1 + (SELECT count(*) FROM l1) AS rank, path, leaf FROM b)
SELECT id, depth, CAST(rank AS INTEGER) AS rank, path, leaf FROM (SELECT 7::BIGINT AS id, 0 AS depth, 1 AS rank, '7' AS path, false AS leaf UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE rank <= 500""")
def call_graph(s, d):
    """What a symbol calls, two steps far, with the path to each; unresolved calls are leaves."""
    return graph.walk(_call_edges(s, d), [7], 2).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


_USES = """uses AS (SELECT 'symbol:' || callee AS "to", 'call' AS kind, 'symbol:' || caller AS source, confidence, false AS terminal FROM calls WHERE resolution = 'resolved'
UNION ALL SELECT 'register:' || register, 'access', 'symbol:' || symbol, confidence, false FROM accesses WHERE mode <> 'read'
UNION ALL SELECT 'symbol:' || symbol, 'handler', 'form:' || m.module, 1.0, false FROM symbols s JOIN modules m ON s.module = m.module WHERE m.kind = 'form'
UNION ALL SELECT 'object:' || c_nationkey, 'right', 'role:' || c_mktsegment, 1.0, true FROM customer
UNION ALL SELECT 'object:' || s_nationkey, 'reference', 'register:' || s_suppkey, 0.9, false FROM supplier
UNION ALL SELECT 'region:' || n_regionkey, 'dependency', 'object:' || n_nationkey, 1.0, false FROM nation)"""


def _uses(s, d):
    """Who uses what, in six kinds of edges: to, kind, source, confidence, terminal."""
    node = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    row = lambda df, to, kind, source, sure=1.0, end=False: df.select(to.alias("to"), F.lit(kind).alias("kind"), source.alias("source"), (F.col(sure) if isinstance(sure, str) else F.lit(sure)).cast("double").alias("confidence"), F.lit(end).alias("terminal"))
    forms = facts.symbols(s, d).join(facts.modules(s, d).where("kind = 'form'").select("module"), "module")
    out = row(facts.calls(s, d).where("resolution = 'resolved'"), node("symbol", "callee"), "call", node("symbol", "caller"), "confidence")
    out = out.union(row(facts.accesses(s, d).where("mode <> 'read'"), node("register", "register"), "access", node("symbol", "symbol"), "confidence"))
    out = out.union(row(forms, node("symbol", "symbol"), "handler", node("form", "module")))
    out = out.union(row(t.table(s, d, "customer"), node("object", "c_nationkey"), "right", node("role", "c_mktsegment"), 1.0, True))
    out = out.union(row(t.table(s, d, "supplier"), node("object", "s_nationkey"), "reference", node("register", "s_suppkey"), 0.9))
    return out.union(row(t.table(s, d, "nation"), node("region", "n_regionkey"), "dependency", node("object", "n_nationkey")))


def _impact_level(k: int, before: str, room: str) -> str:
    seen = " UNION ALL ".join(f"SELECT id, kind FROM l{i}" for i in range(1, k))
    fresh = f"AND (u.source, u.kind) NOT IN (SELECT (id, kind) FROM ({seen}))" if k > 1 else ""
    return f"""g{k} AS (SELECT u.source AS id, u.kind, max(least(u.confidence, p.confidence)) AS confidence, bool_or(u.terminal) AS terminal FROM uses u JOIN {before} p ON p.id = u."to" WHERE u.source <> 'region:1' {fresh} GROUP BY 1, 2),
l{k} AS (SELECT *, {k} AS depth FROM g{k} QUALIFY row_number() OVER (ORDER BY confidence DESC, kind, id) <= {room}), p{k} AS (SELECT id, max(confidence) AS confidence FROM l{k} WHERE NOT terminal GROUP BY 1)"""


@fact_query(f"""WITH {_USES}, p0 AS (SELECT 'region:1' AS id, 1.0::DOUBLE AS confidence), {_impact_level(1, 'p0', '500')}, {_impact_level(2, 'p1', '500 - (SELECT count(*) FROM l1)')}, {_impact_level(3, 'p2', '500 - (SELECT count(*) FROM l1) - (SELECT count(*) FROM l2)')}
SELECT id, kind, depth, confidence, CAST(row_number() OVER (ORDER BY depth, confidence DESC, kind, id) AS INTEGER) AS rank FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""")
def impact_kinds(s, d):
    """What a change reaches over six kinds of edges, within a budget and ranked; roles end a chain."""
    return graph.impact(_uses(s, d), ["region:1"], 3, 500)


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
p(node, path, nodes) AS (SELECT 'supplier:1', 'supplier:1', ['supplier:1'] UNION ALL SELECT u.dst, p.path || '>' || u.dst, list_append(p.nodes, u.dst) FROM p JOIN u ON u.src = p.node WHERE len(p.nodes) <= 2 AND NOT list_contains(p.nodes, u.dst) AND p.node <> 'supplier:2'),
q AS (SELECT path, list_reverse(nodes) AS back FROM p WHERE node = 'supplier:2' QUALIFY len(nodes) = min(len(nodes)) OVER ())
SELECT CAST(row_number() OVER (ORDER BY back) AS INTEGER) AS n, path FROM q ORDER BY back LIMIT 5""")
def dependency_paths(s, d):
    """All shortest paths between two objects, the first five."""
    return graph.shortest_paths(t.edges(s, d), "supplier:1", "supplier:2", 4, 5)


_SURE = """sure AS (SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, max(round(1 - l_discount, 2)) AS confidence FROM lineitem GROUP BY 1, 2),
ends AS (SELECT src, dst, confidence FROM sure UNION ALL SELECT dst, src, confidence FROM sure),
g1 AS (SELECT dst AS id, max(confidence) AS confidence FROM ends WHERE src = 'supplier:3' GROUP BY 1), l1 AS (SELECT id FROM g1 ORDER BY confidence DESC, id LIMIT 29),
g2 AS (SELECT dst AS id, max(confidence) AS confidence FROM ends WHERE src IN (SELECT id FROM l1) AND dst <> 'supplier:3' AND dst NOT IN (SELECT id FROM l1) GROUP BY 1), l2 AS (SELECT id FROM g2 ORDER BY confidence DESC, id LIMIT (SELECT 29 - count(*) FROM l1)),
nodes AS (SELECT 'supplier:3' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2)"""


def _around(s, d):
    pairs = t.table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"))
    e = pairs.select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("dst"), "confidence")
    return graph.radius(e, "supplier:3", 2, 30)


@query(f"WITH {_SURE} SELECT id, depth FROM nodes")
def radius_nodes(s, d):
    """Nodes around one, the surest first, until the cap."""
    return _around(s, d)[0]


@query(f"WITH {_SURE} SELECT src, dst, confidence FROM sure WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def radius_edges(s, d):
    """All edges between the nodes around one."""
    return _around(s, d)[1]


@query(f"WITH {_SURE} SELECT (SELECT count(*) FROM g1) > 29 OR (SELECT count(*) FROM g2) > 29 - (SELECT count(*) FROM l1) AS nodes_cut, EXISTS (SELECT 1 FROM ends WHERE src IN (SELECT id FROM nodes) AND dst NOT IN (SELECT id FROM nodes)) AS depth_cut")
def radius_limits(s, d):
    """Why the surroundings of a node end where they do."""
    return _around(s, d)[2]


def _climb(k: int) -> str:
    late = "* 0.9::DOUBLE" if k > 2 else ""
    return f"""s{k} AS (SELECT u.caller AS symbol, a.register, a.mode, max(least(a.confidence, u.sure) * CASE WHEN u.hub THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END {late}) AS confidence FROM s{k - 1} a JOIN up u ON u.callee = a.symbol WHERE a.symbol NOT IN (SELECT symbol FROM owned) GROUP BY 1, 2, 3)"""


@fact_query(f"""WITH owned AS (SELECT symbol, m.owner FROM symbols s JOIN modules m ON s.module = m.module WHERE m.owner IS NOT NULL AND m.kind = 'object'), w AS (SELECT * FROM accesses WHERE mode = 'write'),
pairs AS (SELECT caller, callee, max(confidence) AS sure FROM calls WHERE kind = 'R' AND resolution = 'resolved' GROUP BY 1, 2), up AS (SELECT *, count(*) OVER (PARTITION BY callee) > 3 AS hub FROM pairs),
s0 AS (SELECT symbol, register, mode, max(confidence) AS confidence FROM w GROUP BY 1, 2, 3), {_climb(1)}, {_climb(2)}, {_climb(3)}
SELECT owner, register, mode, round(max(confidence), 8) AS confidence FROM ({' UNION ALL '.join(f'SELECT owner, register, mode, confidence FROM s{k} JOIN owned USING (symbol)' for k in range(4))}) GROUP BY 1, 2, 3""")
def attributed_accesses(s, d):
    """Which objects write which registers through their code, and how surely."""
    owned = facts.symbols(s, d).join(facts.modules(s, d).where("owner IS NOT NULL AND kind = 'object'").select("module", "owner"), "module").select("symbol", "owner")
    c = facts.calls(s, d).where("kind = 'R' AND resolution = 'resolved'")
    found = graph.attribution(facts.accesses(s, d).where("mode = 'write'"), c, owned, 3, hub=3)
    return found.withColumn("confidence", F.round("confidence", 8))


@fact_query("SELECT callee, m.name AS module, string_agg(caller || ':' || line, ',' ORDER BY caller, line, calls.file) AS sites, CAST(count(*) AS BIGINT) AS n FROM calls JOIN symbols s ON s.symbol = caller JOIN modules m ON m.module = s.module WHERE component = 'Brand#1' OR component = 'Brand#2' GROUP BY 1, 2")
def find_references(s, d):
    """References to each symbol from chosen components, grouped by module in order."""
    own = facts.symbols(s, d).where("component IN ('Brand#1', 'Brand#2')").join(facts.modules(s, d).select("module", F.col("name").alias("m")), "module").select(F.col("symbol").alias("caller"), "m")
    site = F.struct("caller", "line", "file")
    g = facts.calls(s, d).join(own, "caller").groupBy("callee", F.col("m").alias("module")).agg(F.array_sort(F.collect_list(site)).alias("x"))
    shown = F.transform("x", lambda y: F.concat_ws(":", y["caller"].cast("string"), y["line"].cast("string")))
    return g.select("callee", "module", F.array_join(shown, ",").alias("sites"), F.size("x").cast("long").alias("n"))


@query("""WITH m AS (SELECT l_partkey AS target, l_suppkey AS extension, min(l_orderkey) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT target AS id, 'interceptor' AS kind, extension AS source, 1 AS depth, 1.0::DOUBLE AS confidence FROM m WHERE target = 7 UNION ALL SELECT l_partkey, 'call', l_orderkey, 1, max(round(1 - l_discount, 2)) FROM lineitem WHERE l_partkey = 7 GROUP BY 1, 2, 3, 4""")
def root_interceptors(s, d):
    """Direct users of a symbol, and the extensions that intercept it, at depth one."""
    r = t.references(s, d).where("dst = 7")
    own = r.groupBy(F.col("dst").alias("id"), F.lit("call").alias("kind"), F.col("src").alias("source"), F.lit(1).alias("depth")).agg(F.max(F.round("confidence", 2)).alias("confidence"))
    extensions = r.where("kind = 'R'").select(F.col("dst").alias("id"), F.lit("interceptor").alias("kind"), F.col("owner").alias("source"), F.lit(1).alias("depth"), F.lit(1.0).alias("confidence")).distinct()
    return own.unionByName(extensions)


@query(f"""WITH {_EDGES}, ends AS (SELECT dst AS id, 1 AS i, 0 AS o, layer FROM edges UNION ALL SELECT src, 0, 1, layer FROM edges), deg AS (SELECT id, sum(i) AS fan_in, sum(o) AS fan_out, sum(CASE WHEN layer <> 'base' THEN 1 ELSE 0 END) AS extended FROM ends GROUP BY id)
SELECT 'supplier:' || s_suppkey AS id, s_name AS name, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out, CAST(coalesce(extended, 0) AS BIGINT) AS extended, s_acctbal < 0 AS stale FROM supplier LEFT JOIN deg ON deg.id = 'supplier:' || s_suppkey""")
def node_cards(s, d):
    """Cards of objects: name, degrees, edges that extensions add, badge."""
    e = t.edges(s, d)
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "layer").union(e.select("src", F.lit(0), F.lit(1), "layer")).where(F.col("id").startswith("supplier:"))
    deg = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum(F.when(F.col("layer") != "base", 1).otherwise(0)).alias("extended"))
    own = t.table(s, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("stale"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(deg, "id", "left").select("id", "name", zero("fan_in"), zero("fan_out"), zero("extended"), "stale")


@fact_query("SELECT c.file, CAST(c.line AS INTEGER) AS step, s.name FROM (SELECT DISTINCT file, line, caller FROM calls) c JOIN symbols s ON s.symbol = c.caller")
def edge_evidence(s, d):
    """Evidence of edges, kept as JSON chains and unfolded into steps with the symbols' names."""
    step = F.struct(F.col("line").alias("step"), F.col("caller").alias("symbol"))
    chains = facts.calls(s, d).groupBy("file").agg(F.to_json(F.array_sort(F.collect_set(step))).alias("evidence"))
    steps = chains.select("file", F.inline(F.from_json("evidence", "array<struct<step:int,symbol:long>>")))
    return steps.join(facts.symbols(s, d).select("symbol", "name"), "symbol").select("file", "step", "name")


@query(f"""WITH {_EDGES}, ends AS (SELECT dst AS id FROM edges UNION ALL SELECT src FROM edges), deg AS (SELECT id, count(*) AS n FROM ends GROUP BY id), o AS (SELECT 'supplier:' || s_suppkey AS id, lower(s_name) AS name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, lower(n_name) FROM nation),
r AS (SELECT o.id, name, CAST(coalesce(n, 0) AS BIGINT) AS degree, CASE WHEN name = 'nation_1' THEN 0 WHEN starts_with(name, 'nation_1') THEN 1 WHEN contains(name, '_1') OR contains(name, '1') THEN 2 END AS tier FROM o LEFT JOIN deg ON deg.id = o.id)
SELECT id, tier, degree FROM r WHERE tier IS NOT NULL ORDER BY tier, degree = 0, length(name), name, id LIMIT 40""")
def map_search(s, d):
    """Objects by exact name, prefix or part of it; connected ones first, then shorter names."""
    o = t.objects(s, d).where(F.col("mtype").isin("supplier", "nation")).select("id", F.lower("name").alias("name"))
    e = t.edges(s, d)
    deg = e.select(F.col("dst").alias("id")).union(e.select("src")).where(F.col("id").rlike("^(supplier|nation):")).groupBy("id").agg(F.count("*").alias("degree"))
    tier = F.when(F.col("name") == "nation_1", 0).when(F.col("name").startswith("nation_1"), 1).when(F.col("name").contains("1"), 2)
    r = o.join(deg, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), tier.alias("tier")).where("tier IS NOT NULL")
    return r.orderBy("tier", F.col("degree") == 0, F.length("name"), "name", "id").limit(40).select("id", "tier", "degree")


@query("""WITH declared AS (SELECT DISTINCT l_partkey AS object, l_suppkey AS register FROM lineitem WHERE l_linestatus = 'O'), used AS (SELECT l_partkey AS object, l_suppkey AS register, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT coalesce(d.object, u.object) AS object, coalesce(d.register, u.register) AS register, CASE WHEN u.object IS NULL THEN 'declared' WHEN d.object IS NULL THEN 'used' ELSE 'both' END AS state, coalesce(fields, '') AS fields FROM declared d FULL JOIN used u ON d.object = u.object AND d.register = u.register""")
def movements_report(s, d):
    """Registers that objects declare against those that their code writes, with the fields set."""
    li = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_suppkey").alias("register"), "l_linestatus", "l_returnflag")
    return rel.movements(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'").withColumnRenamed("l_returnflag", "field"))


@fact_query("SELECT register, a.symbol, mode, n_name AS owner, a.confidence FROM accesses a JOIN symbols s ON s.symbol = a.symbol LEFT JOIN modules m ON m.module = s.module AND m.kind = 'object' LEFT JOIN nation ON n_nationkey = m.owner WHERE mode = 'write' AND a.confidence >= 0.95")
def register_writes(s, d):
    """Who writes each register, with the owner of the code if it has one."""
    m = facts.modules(s, d).where("kind = 'object'").join(t.table(s, d, "nation").select(F.col("n_nationkey").alias("owner"), "n_name"), "owner").select("module", F.col("n_name").alias("owner"))
    own = facts.symbols(s, d).select("symbol", "module").join(m, "module", "left").select("symbol", "owner")
    return facts.accesses(s, d).where("mode = 'write' AND confidence >= 0.95").join(own, "symbol", "left").select("register", "symbol", "mode", "owner", "confidence")


@query("SELECT o_orderkey AS query, p_name AS object, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%rod' GROUP BY 1, 2")
def queries_using(s, d):
    """Queries that use an object, with the fields that they name."""
    p = t.table(s, d, "part").where(F.col("p_name").endswith("rod")).select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("object"))
    return t.references(s, d).join(p, "dst").groupBy(F.col("src").alias("query"), "object").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("fields"))


@query(r"""WITH c AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS lang FROM pages)
SELECT host, 'svc-' || lang AS endpoint, CAST(count(*) AS BIGINT) AS calls FROM c WHERE lang IN ('en', 'de', 'fr') GROUP BY 1, 2""")
def cross_links(s, d):
    """Calls between projects: which host calls which endpoint, and how often."""
    e = s.createDataFrame([(x, f"svc-{x}") for x in ("en", "de", "fr")], "head string, endpoint string")
    c = t.table(s, d, "pages").select(text.host(F.col("url")).alias("host"), F.get(text.segments(F.col("url")), F.lit(0)).alias("head"))
    return c.join(F.broadcast(e), "head").groupBy("host", "endpoint").agg(F.count("*").alias("calls"))  # three endpoints


def _traced_level(k: int) -> str:
    late = "* 0.9::DOUBLE" if k > 2 else ""
    return f"""full{k} AS (SELECT access FROM best{k - 1} GROUP BY 1 HAVING count(*) >= 12), go{k} AS (SELECT * FROM f{k - 1} WHERE symbol NOT IN (SELECT symbol FROM owned)),
step{k} AS (SELECT g.access, u.caller AS symbol, least(g.confidence, u.sure) * CASE WHEN u.hub THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END {late} AS confidence, g.penalised OR u.hub OR {k > 2} AS penalised, u.cut FROM go{k} g JOIN up u ON u.callee = g.symbol WHERE g.access NOT IN (SELECT access FROM full{k})),
new{k} AS (SELECT access, symbol, max((confidence, penalised)) AS m FROM step{k} GROUP BY 1, 2),
f{k} AS (SELECT n.access, n.symbol, n.m[1] AS confidence, n.m[2] AS penalised FROM new{k} n LEFT JOIN best{k - 1} b ON b.access = n.access AND b.symbol = n.symbol WHERE b.access IS NULL OR n.m[1] > b.confidence),
best{k} AS (SELECT access, symbol, max(confidence) AS confidence FROM (SELECT * FROM best{k - 1} UNION ALL SELECT access, symbol, confidence FROM f{k}) GROUP BY 1, 2)"""


@fact_query(f"""WITH owned AS (SELECT symbol, m.owner FROM symbols s JOIN modules m ON s.module = m.module WHERE m.owner IS NOT NULL AND m.kind = 'object'),
pairs AS (SELECT caller, callee, max(confidence) AS sure FROM calls WHERE kind = 'R' AND resolution = 'resolved' GROUP BY 1, 2),
up AS (SELECT *, count(*) OVER (PARTITION BY callee) > 3 AS hub, count(*) OVER (PARTITION BY callee) > 5 AS cut FROM pairs QUALIFY row_number() OVER (PARTITION BY callee ORDER BY caller) <= 5),
f0 AS (SELECT symbol || '>' || register AS access, symbol, max(confidence) AS confidence, false AS penalised FROM accesses WHERE mode = 'clear' AND confidence > 0.95 GROUP BY 1, 2), best0 AS (SELECT access, symbol, confidence FROM f0), {', '.join(_traced_level(k) for k in range(1, 5))},
hits AS ({' UNION ALL '.join(f'SELECT access, owner, confidence, penalised, {k} AS steps FROM f{k} JOIN owned USING (symbol)' for k in range(4))}), cuts AS ({' UNION '.join(f'SELECT access FROM go{k} WHERE access IN (SELECT access FROM full{k}) UNION SELECT access FROM step{k} WHERE cut' for k in range(1, 5))}),
one AS (SELECT access, owner, max((confidence, -steps, penalised)) AS m FROM hits GROUP BY 1, 2)
SELECT access, owner, round(m[1], 8) AS confidence, CAST(-m[2] AS INTEGER) AS steps, m[3] AS penalised, access IN (SELECT access FROM cuts) AS truncated FROM one""")
def traced_accesses(s, d):
    """The objects that each access climbs to, with where the climb was cut."""
    owned = facts.symbols(s, d).join(facts.modules(s, d).where("owner IS NOT NULL AND kind = 'object'").select("module", "owner"), "module").select("symbol", "owner")
    c = facts.calls(s, d).where("kind = 'R' AND resolution = 'resolved'")
    a = facts.accesses(s, d).where("mode = 'clear' AND confidence > 0.95").select(F.concat_ws(">", F.col("symbol").cast("string"), F.col("register").cast("string")).alias("access"), "symbol", "confidence")
    found = graph.traced_attribution(a, c, owned, node_budget=12, caller_cap=5, hub=3, most_steps=4)
    return found.withColumn("confidence", F.round("confidence", 8))
