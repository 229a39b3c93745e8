"""Registered queries: resolving names, reading indexes back, lookups by id and packs of an object, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolve
from ..sources import facts
from ..sources import tables as t
from ..sources.shared import scratch
from .lookups import fact_query
from .queries import _EDGES, query

_STATE = "CASE {0} WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN target END AS target"


@query(f"""WITH m AS (SELECT p_brand AS module, p_name AS method, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_size <= 20 GROUP BY 1, 2)
SELECT p_partkey AS site, {_STATE.format("WHEN p_brand NOT IN (SELECT module FROM m) THEN 'dynamic'")} FROM part LEFT JOIN m ON module = p_brand AND method = p_name""")
def qualified_calls(s, d):
    """Calls through a module's name: one method resolves, more are ambiguous, an unknown name is dynamic."""
    p = t.table(s, d, "part").select("p_partkey", F.col("p_brand").alias("qualifier"), F.col("p_name").alias("method"), "p_size")
    methods = p.where("p_size <= 20").select(F.col("qualifier").alias("module"), "method", F.col("p_partkey").alias("target"))
    return resolve.qualified(p.select(F.col("p_partkey").alias("site"), "qualifier", "method"), methods)


@query(f"""WITH m AS (SELECT p_type AS mtype, p_brand AS object, p_name AS method, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_retailprice >= 905 GROUP BY 1, 2, 3)
SELECT p_partkey AS site, {_STATE.format('')} FROM part LEFT JOIN m ON mtype = p_type AND object = p_brand AND method = p_name""")
def manager_calls(s, d):
    """Calls through an object's manager: exported methods only."""
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("site"), F.col("p_type").alias("mtype"), F.col("p_brand").alias("object"), F.col("p_name").alias("method"), (F.col("p_retailprice") >= 905).alias("exported"))
    return resolve.managed(p.drop("exported"), p.withColumnRenamed("site", "target"))


@query("""WITH tables AS (SELECT DISTINCT l_orderkey AS query, l_suppkey AS alias, l_suppkey % 7 AS object FROM lineitem), used AS (SELECT DISTINCT l_orderkey AS query, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS alias, l_linenumber AS field FROM lineitem), members AS (SELECT DISTINCT s_suppkey % 7 AS object, s_nationkey % 8 AS field FROM supplier),
single AS (SELECT query, min(object) AS object FROM tables GROUP BY 1 HAVING count(*) = 1), r AS (SELECT u.query, u.field, CASE WHEN u.alias IS NULL THEN s.object ELSE tt.object END AS object FROM used u LEFT JOIN tables tt ON tt.query = u.query AND tt.alias = u.alias LEFT JOIN single s ON s.query = u.query)
SELECT query, r.field, r.object, m.object IS NOT NULL AS known FROM r LEFT JOIN members m ON m.object = r.object AND m.field = r.field""")
def query_fields(s, d):
    """Fields of queries with their objects; one without an alias is clear only among one table."""
    li = t.table(s, d, "lineitem")
    tables = li.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("alias"), (F.col("l_suppkey") % 7).alias("object")).distinct()
    used = li.select(F.col("l_orderkey").alias("query"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("alias"), F.col("l_linenumber").alias("field")).distinct()
    return resolve.fields(used, tables, t.table(s, d, "supplier").select((F.col("s_suppkey") % 7).alias("object"), (F.col("s_nationkey") % 8).alias("field")))


@query("""WITH y AS (SELECT p_size AS form, p_name AS name, min(p_partkey) AS symbol FROM part GROUP BY 1, 2), b AS (SELECT DISTINCT l_linenumber AS form, l_returnflag AS event, p_name AS handler FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT b.form, event, handler, symbol FROM b LEFT JOIN y ON y.form = b.form AND y.name = b.handler""")
def form_handlers(s, d):
    """Handlers that forms bind, with the symbol of their module if there is one."""
    p = t.table(s, d, "part")
    b = t.table(s, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_linenumber").alias("form"), F.col("l_returnflag").alias("event"), F.col("p_name").alias("handler")).distinct()
    return resolve.handlers(b, p.groupBy(F.col("p_size").alias("form"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("symbol")))


@query("SELECT DISTINCT l_orderkey AS owner, l_linenumber AS member, s_suppkey AS object FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
def typed_members(s, d):
    """Members whose types name known objects."""
    m = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("member")).agg(F.collect_list(F.concat(F.lit("Ref."), "l_suppkey")).alias("types"))
    return resolve.typed_by(m, t.table(s, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("Ref."), "s_suppkey").alias("type"), F.col("s_suppkey").alias("object")))


@query("""SELECT DISTINCT c_name AS name, p_partkey AS object FROM customer JOIN part ON p_type = CASE c_mktsegment WHEN 'BUILDING' THEN 'PROMO' ELSE 'none' END UNION SELECT c_name, p_partkey FROM customer JOIN part ON p_partkey = c_custkey WHERE c_mktsegment <> 'BUILDING'""")
def subscribed_objects(s, d):
    """Objects of event subscriptions: those of a type, or of a whole kind."""
    c = t.table(s, d, "customer").join(t.table(s, d, "part").select(F.col("p_partkey").alias("c_custkey"), "p_type"), "c_custkey", "left")
    sub = c.select(F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "kind").otherwise("type").alias("kind"), F.when(F.col("c_mktsegment") == "BUILDING", "PROMO").otherwise(F.concat_ws(".", "p_type", "c_custkey")).alias("source"))
    return resolve.subscription_sources(sub, t.table(s, d, "part").select(F.col("p_type").alias("mtype"), F.col("p_partkey").alias("object")))


@fact_query("WITH r AS (SELECT role, list(DISTINCT object) AS a FROM grants WHERE value GROUP BY 1) SELECT x.role AS a, y.role AS b, CAST(len(list_intersect(x.a, y.a)) AS INTEGER) AS common FROM r x JOIN r y ON x.role < y.role")
def common_rights(s, d):
    """How many objects the roles of each pair both reach; there are some dozen roles."""
    r = facts.grants(s, d).where("value").groupBy("role").agg(F.collect_set("object").alias("o"))
    x, y = r.toDF("a", "oa"), r.toDF("b", "ob")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.size(F.array_intersect("oa", "ob")).alias("common"))


@query("""SELECT l_orderkey AS file, l_linenumber AS place, l_partkey AS reference, coalesce(max(m.l_suppkey), -1) AS member FROM lineitem l LEFT JOIN (SELECT DISTINCT l_orderkey AS f, l_linenumber AS k, l_suppkey FROM lineitem WHERE l_returnflag = 'A') m ON m.f = l.l_orderkey AND m.k = l.l_linenumber WHERE l.l_returnflag <> 'A' GROUP BY 1, 2, 3""")
def raw_references(s, d):
    """References of a parser matched with the members that end at the same place of the same file."""
    li = t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("reference"), "l_suppkey", "l_returnflag")
    members = li.where("l_returnflag = 'A'").groupBy("file", "place").agg(F.max("l_suppkey").alias("member"))
    return li.where("l_returnflag <> 'A'").select("file", "place", "reference").distinct().join(members, ["file", "place"], "left").select("file", "place", "reference", F.coalesce("member", F.lit(-1)).alias("member"))


@fact_query("SELECT s.module, register, mode, CAST(count(*) AS BIGINT) AS n, s_name IS NOT NULL AS known FROM accesses a JOIN symbols s ON s.symbol = a.symbol LEFT JOIN supplier ON s_suppkey = register AND s_acctbal > 0 GROUP BY 1, 2, 3, 5")
def derived_accesses(s, d):
    """Register accesses of every module, with whether the register is known."""
    known = t.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("register"), F.lit(True).alias("k"))
    a = facts.accesses(s, d).join(facts.symbols(s, d).select("symbol", "module"), "symbol").groupBy("module", "register", "mode").agg(F.count("*").alias("n"))
    return a.join(known, "register", "left").select("module", "register", "mode", "n", F.coalesce("k", F.lit(False)).alias("known"))


@query(f"""WITH {_EDGES}, a AS (SELECT 'supplier:' || s_suppkey AS task, CASE WHEN s_acctbal > 5000 THEN 'rights' ELSE 'bugfix' END AS intent, 'supplier:' || s_suppkey AS id FROM supplier)
SELECT DISTINCT task, kind AS category, CASE WHEN dst = a.id THEN src ELSE dst END AS id, 1 AS depth FROM a JOIN edges ON (intent = 'rights' AND kind = 'supplier-nation' AND src = a.id) OR (intent = 'bugfix' AND kind = 'part-supplier' AND dst = a.id) OR (intent = 'bugfix' AND kind = 'supplier-nation' AND src = a.id)""")
def intent_expansion(s, d):
    """What the intents of tasks ask for around their anchors."""
    sup = F.concat(F.lit("supplier:"), F.col("s_suppkey"))
    a = t.table(s, d, "supplier").select(sup.alias("task"), F.when(F.col("s_acctbal") > 5000, "rights").otherwise("bugfix").alias("intent"), sup.alias("id"))
    return resolve.expanded(a, t.edges(s, d), {"rights": [("supplier-nation", "out")], "bugfix": [("part-supplier", "in"), ("supplier-nation", "out")]})


@fact_query("SELECT 'structure' AS section, n_name AS object, m.name AS item FROM modules m JOIN nation ON n_nationkey = m.owner UNION ALL SELECT 'export', n_name, s.name FROM symbols s JOIN modules m ON m.module = s.module JOIN nation ON n_nationkey = m.owner WHERE exported GROUP BY 2, 3 UNION ALL SELECT 'usage', n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2, 3")
def object_pack(s, d):
    """What an object is: its structure, its exports and where it is used."""
    n = t.table(s, d, "nation").select(F.col("n_nationkey").alias("owner"), F.col("n_name").alias("object"))
    m = facts.modules(s, d).join(n, "owner")
    exports = facts.symbols(s, d).where("exported").join(m.select("module", "object"), "module").select("object", "name").distinct()
    used = t.table(s, d, "customer").select(F.col("c_nationkey").alias("owner"), "c_mktsegment").distinct().join(n, "owner")
    row = lambda df, section, item: df.select(F.lit(section).alias("section"), "object", F.col(item).alias("item"))
    return row(m, "structure", "name").union(row(exports, "export", "name")).union(row(used, "usage", "c_mktsegment"))


@query("SELECT DISTINCT p_partkey AS id, field, word FROM (SELECT p_partkey, 'name' AS field, unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT p_partkey, 'module', lower(p_type) FROM part) WHERE word <> ''")
def inverted_index(s, d):
    """Which words stand in which field of which method."""
    word = lambda f, c: F.transform(text.tokens(F.col(c)), lambda w: F.struct(F.lit(f).alias("field"), w.alias("word")))
    return t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.inline(F.array_distinct(F.concat(word("name", "p_name"), word("module", "p_type")))))


@query("SELECT p_partkey AS id, p_name AS name, p_type AS owner FROM part")
def json_index(s, d):
    """An index that was written as compressed JSON, read back with a fixed schema."""
    path = scratch(s)
    t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("owner")).write.option("compression", "gzip").json(path)
    return s.read.schema("id long, name string, owner string").json(path)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 42")
def point_lookup(s, d):
    """One symbol by its id; the filter reaches the scan."""
    return t.table(s, d, "part").where("p_partkey = 42").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT c_custkey AS id, c_name AS identity FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_custkey = 7)")
def identity_lookup(s, d):
    """The id of an identity."""
    one = t.table(s, d, "customer").where("c_custkey = 7").select("c_name")
    return t.table(s, d, "customer").join(F.broadcast(one), "c_name", "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("identity"))  # one name


@query("SELECT sha256(text) AS hash, max(length(text)) AS chars, CAST(count(*) AS BIGINT) AS files FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_fetch(s, d):
    """Contents by hash, once each, as stored bytes that are decoded again."""
    b = t.table(s, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("hash"), F.base64(F.encode("text", "UTF-8")).alias("blob"))
    return b.groupBy("hash").agg(F.max(F.length(F.decode(F.unbase64("blob"), "UTF-8"))).alias("chars"), F.count("*").alias("files"))
