"""Registered queries: rule engines, integrity checks and diagnostics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings
from ..sources import facts
from ..sources import tables as t
from ..sources.shared import parted
from .lookups import fact_query
from .queries import query


@query("""WITH objects AS (SELECT n_nationkey AS object FROM nation), contents AS (SELECT DISTINCT c_mktsegment AS subsystem, c_nationkey AS object FROM customer WHERE c_acctbal > 9000), interface AS (SELECT s_nationkey AS object, s_acctbal > 0 AS shown FROM supplier),
opts AS (SELECT s_nationkey AS object, bool_or(s_acctbal > 5000) AS enabled FROM supplier GROUP BY 1), sections AS (SELECT DISTINCT c_mktsegment AS subsystem, c_mktsegment <> 'BUILDING' AND c_mktsegment <> 'MACHINERY' AS visible FROM customer), g AS (SELECT c_nationkey AS object, o_totalprice > 400000 AS value FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'NotInAnySubsystem' AS rule, object FROM objects WHERE object NOT IN (SELECT object FROM contents) UNION ALL SELECT 'NotInCommandInterface', object FROM objects WHERE object NOT IN (SELECT object FROM interface WHERE shown)
UNION ALL SELECT 'HiddenByFunctionalOption', object FROM opts WHERE NOT enabled UNION ALL SELECT 'SectionHidden', object FROM contents JOIN sections USING (subsystem) GROUP BY 2 HAVING NOT bool_or(visible) UNION ALL SELECT 'NoRoleGrantsRights', object FROM objects WHERE object NOT IN (SELECT object FROM g WHERE value)""")
def visibility_audit(s, d):
    """Why objects can't be seen."""
    c, sup = t.table(s, d, "customer"), t.table(s, d, "supplier")
    g = t.table(s, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("object"), (F.col("o_totalprice") > 400000).alias("value"))
    sections = c.select(F.col("c_mktsegment").alias("subsystem"), ((F.col("c_mktsegment") != "BUILDING") & (F.col("c_mktsegment") != "MACHINERY")).alias("visible")).distinct()
    return findings.visibility(
        t.table(s, d, "nation").select(F.col("n_nationkey").alias("object")),
        c.where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("subsystem"), F.col("c_nationkey").alias("object")).distinct(),
        sup.select(F.col("s_nationkey").alias("object"), (F.col("s_acctbal") > 0).alias("shown")),
        sup.select(F.col("s_nationkey").alias("object"), (F.col("s_acctbal") > 5000).alias("enabled")),
        sections, g,
    )


_EVENT = "CASE l_linenumber WHEN 1 THEN 'BeforeWrite' WHEN 2 THEN 'OnWrite' WHEN 3 THEN 'Posting' WHEN 4 THEN 'UndoPosting' ELSE 'Other' END"
_HANDLERS = f"""h AS (SELECT l_orderkey AS object, {_EVENT} AS event, min('h' || l_partkey) AS name, bool_or(l_returnflag = 'R') AS writes, bool_or(l_returnflag = 'A') AS moves, bool_or(l_linestatus = 'F') AS checks_load FROM lineitem GROUP BY 1, 2),
u AS (SELECT DISTINCT l_orderkey AS object, {_EVENT} AS event, 's' || l_suppkey AS name FROM lineitem)"""


#: Lines of orders that one task groups.
LINES = 250_000


def _handlers(s, d):
    """Handlers and subscriptions of objects; either has its lines parted by their number and object, once for all that follows."""
    event = F.element_at(F.array(*map(F.lit, (*findings.EVENTS, "Other"))), F.least(F.col("l_linenumber"), F.lit(5)))
    rows = t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("object"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    li = parted(rows, "object", rows.count(), LINES).withColumn("event", event)
    h = li.groupBy("object", "event").agg(F.min(F.concat(F.lit("h"), "l_partkey")).alias("name"), F.bool_or(F.col("l_returnflag") == "R").alias("writes"), F.bool_or(F.col("l_returnflag") == "A").alias("moves"), F.bool_or(F.col("l_linestatus") == "F").alias("checks_load"))
    return h, li.select("object", "event", "l_suppkey").distinct().select("object", "event", F.concat(F.lit("s"), "l_suppkey").alias("name"))


@query(f"""WITH {_HANDLERS}, e AS (SELECT object, event, 'handler' AS source, name FROM h UNION ALL SELECT object, event, 'subscription', name FROM u)
SELECT object, CAST(row_number() OVER (PARTITION BY object ORDER BY CASE event WHEN 'BeforeWrite' THEN 1 WHEN 'OnWrite' THEN 2 WHEN 'Posting' THEN 3 ELSE 4 END, source, name) AS INTEGER) AS step, event, source, name FROM e WHERE event <> 'Other'""")
def write_path(s, d):
    """What runs when an object is written, in order."""
    return findings.write_steps(*_handlers(s, d))


@query(f"""WITH {_HANDLERS} SELECT DISTINCT 'SubscriptionOrder' AS rule, object FROM (SELECT object, event FROM u GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'MovementsUnavailable', object FROM h WHERE moves AND event = 'BeforeWrite'
UNION ALL SELECT 'WriteInsideHandler', object FROM h WHERE writes AND event = 'OnWrite' UNION ALL SELECT 'NoExchangeLoadCheck', object FROM h WHERE event IN ('BeforeWrite', 'OnWrite') GROUP BY object HAVING bool_and(NOT checks_load)""")
def write_warnings(s, d):
    """Doubtful spots on the way of a write."""
    return findings.write_warnings(*_handlers(s, d))


_CODE = {
    "AF": "Для Каждого Стр Из Таблица Цикл", "AO": "Выборка = Запрос.Выполнить().Выбрать();", "NF": "Остатки = РегистрыНакопления.Запас.Остатки(Дата);",
    "NO": "Блокировка.Заблокировать();", "RF": "КонецЦикла;", "RO": "Движения.Запас.Записывать = Истина;",
}


@query("""WITH l AS (SELECT l_orderkey AS module, l_linenumber AS line, min(l_returnflag || l_linestatus) AS code FROM lineitem GROUP BY 1, 2), w AS (SELECT *, sum(CASE code WHEN 'AF' THEN 1 WHEN 'RF' THEN -1 ELSE 0 END) OVER o AS depth, max(CASE WHEN code = 'NO' THEN 1 ELSE 0 END) OVER o AS locked FROM l WINDOW o AS (PARTITION BY module ORDER BY line))
SELECT 'QueryInLoop' AS rule, module, line FROM w WHERE code = 'AO' AND depth > 0 UNION ALL SELECT 'BalanceReadWithoutLock', module, line FROM w WHERE code = 'NF' AND locked = 0 UNION ALL SELECT 'NoWriteFlag', module, 0 FROM l GROUP BY module HAVING NOT bool_or(code = 'RO')""")
def posting_review(s, d):
    """Findings in posting handlers: one order is a handler, its lines are lines of code."""
    li = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("line")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("code"))
    code = F.element_at(F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair]), F.col("code"))
    return findings.posting_review(li.select("module", "line", code.alias("text")))


@query("""WITH i AS (SELECT l_partkey AS target, l_suppkey AS extension, CASE l_returnflag WHEN 'R' THEN 'instead' ELSE 'after' END AS mode, l_discount > 0.01 AS continues, l_tax > 0.07 AS wired FROM lineitem), a AS (SELECT l_partkey AS target, l_suppkey AS extension, l_linenumber AS name, l_quantity > 1 AS prefixed, l_discount > 0.095 AS removes FROM lineitem WHERE l_linestatus = 'O')
SELECT DISTINCT 'InsteadWithoutContinue' AS rule, target FROM i WHERE mode = 'instead' AND NOT continues UNION ALL SELECT DISTINCT 'InsteadDuplicatesBaseWiring', target FROM i WHERE mode = 'instead' AND wired UNION ALL SELECT 'MultipleChangeAttributes', target FROM a GROUP BY target HAVING count(DISTINCT extension) > 1
UNION ALL SELECT DISTINCT 'NameCollision', target FROM (SELECT target, name FROM a GROUP BY 1, 2 HAVING count(DISTINCT extension) > 1) UNION ALL SELECT DISTINCT 'UnprefixedName', target FROM a WHERE NOT prefixed UNION ALL SELECT DISTINCT 'ChangeAttributesWithRemoval', target FROM a WHERE removes""")
def form_conflicts(s, d):
    """Extensions that get in each other's way."""
    li = t.table(s, d, "lineitem").withColumnsRenamed({"l_partkey": "target", "l_suppkey": "extension"})
    i = li.select("target", "extension", F.when(F.col("l_returnflag") == "R", "instead").otherwise("after").alias("mode"), (F.col("l_discount") > 0.01).alias("continues"), (F.col("l_tax") > 0.07).alias("wired"))
    a = li.where("l_linestatus = 'O'").select("target", "extension", F.col("l_linenumber").alias("name"), (F.col("l_quantity") > 1).alias("prefixed"), (F.col("l_discount") > 0.095).alias("removes"))
    return findings.form_conflicts(i, a)


@query("""SELECT b.p_partkey AS object, b.p_name AS name, l_suppkey AS extension, b.p_type AS original, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS modes FROM lineitem JOIN part b ON b.p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2, 3, 4""")
def extension_context(s, d):
    """What extensions borrow and intercept, with the original beside it."""
    base = t.table(s, d, "part").select(F.col("p_partkey").alias("object"), F.col("p_name").alias("name"), F.col("p_type").alias("original"))
    own = t.table(s, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("object"), F.col("l_suppkey").alias("extension")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("modes"))
    return own.join(base, "object").select("object", "name", "extension", "original", "modes")


@query("""SELECT l_partkey AS object, 'type' AS place, CAST(l_suppkey AS VARCHAR) AS name, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3
UNION ALL SELECT o_custkey, 'role', o_orderpriority, count(*) FROM orders GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT l_partkey, 'template', CAST(l_orderkey AS VARCHAR), 1 FROM lineitem WHERE l_returnflag = 'A'""")
def metadata_usages(s, d):
    """Where objects are used: as types, in roles, in templates."""
    li = t.table(s, d, "lineitem")
    typed = li.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").cast("string").alias("owner"), "l_linenumber").agg(F.collect_set("l_partkey").alias("types"))
    shown = li.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").cast("string").alias("name")).agg(F.collect_set("l_partkey").alias("objects"))
    return findings.usages(typed, t.table(s, d, "orders").select(F.col("o_orderpriority").alias("role"), F.col("o_custkey").alias("object")), shown)


@query("""WITH f AS (SELECT DISTINCT p_type AS function, CASE p_type WHEN 'PROMO' THEN 3 ELSE 1 END AS least, CASE p_type WHEN 'SMALL' THEN 3 ELSE 6 END AS most FROM part WHERE p_type <> 'LARGE'),
c AS (SELECT l_orderkey AS file, l_linenumber AS line, p_type AS function, l_linenumber AS args, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS object, CASE WHEN l_linestatus = 'O' AND l_quantity < 10 THEN CASE WHEN l_quantity < 3 THEN p_type ELSE p_name END END AS assigns, l_suppkey AS form FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT DISTINCT l_suppkey AS form, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'), o AS (SELECT s_suppkey AS object FROM supplier WHERE s_acctbal > 0)
SELECT 'UnknownGlobalFunction' AS rule, file, line FROM c WHERE function NOT IN (SELECT function FROM f) UNION ALL SELECT 'WrongArgCount', file, line FROM c JOIN f USING (function) WHERE args < least OR args > most UNION ALL SELECT 'UnknownMetadataObject', file, line FROM c WHERE object IS NOT NULL AND object NOT IN (SELECT object FROM o)
UNION ALL SELECT 'AssignToGlobalName', file, line FROM c WHERE assigns IN (SELECT function FROM f) UNION ALL SELECT 'LocalShadowsAttribute', file, line FROM c WHERE assigns IS NOT NULL AND (form, assigns) IN (SELECT (form, name) FROM a)""")
def code_validator(s, d):
    """Findings of the code validator that facts decide."""
    p = t.table(s, d, "part")
    li = t.table(s, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    f = p.where("p_type <> 'LARGE'").select(F.col("p_type").alias("function")).distinct().select("function", F.when(F.col("function") == "PROMO", 3).otherwise(1).alias("least"), F.when(F.col("function") == "SMALL", 3).otherwise(6).alias("most"))
    assigns = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10), F.when(F.col("l_quantity") < 3, F.col("p_type")).otherwise(F.col("p_name")))
    c = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("function"), F.col("l_linenumber").alias("args"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("object"), assigns.alias("assigns"), F.col("l_suppkey").alias("form"))
    a = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("form"), F.col("p_name").alias("name"))
    return findings.validated(c, f, t.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("object")), a)


@fact_query("""WITH c AS (SELECT file * 10 + line AS site, a.module = b.module AS same_module, b.exported, m.kind <> 'form' AS caller_server, n.kind = 'object' AS callee_server FROM calls JOIN symbols a ON a.symbol = caller JOIN symbols b ON b.symbol = callee JOIN modules m ON m.module = a.module JOIN modules n ON n.module = b.module WHERE resolution = 'resolved')
SELECT 'NotExported' AS rule, site FROM c WHERE NOT same_module AND NOT exported UNION ALL SELECT 'ContextMismatch', site FROM c WHERE NOT caller_server AND callee_server""".replace("file * 10", "calls.file * 10"))
def resolver_diagnostics(s, d):
    """Resolved calls of what is not exported or can't run where it is called."""
    m = facts.modules(s, d).select("module", F.col("kind").alias("k"))
    own = facts.symbols(s, d).select("symbol", "module", "exported").join(m, "module")
    a = own.select(F.col("symbol").alias("caller"), F.col("module").alias("am"), findings.runs_on_server(F.col("k"), F.lit("")).alias("caller_server"))
    b = own.select(F.col("symbol").alias("callee"), F.col("module").alias("bm"), "exported", (F.col("k") == "object").alias("callee_server"))
    c = facts.calls(s, d).where("resolution = 'resolved'").join(a, "caller").join(b, "callee")
    return findings.resolver_diagnostics(c.select((F.col("file") * 10 + F.col("line")).alias("site"), (F.col("am") == F.col("bm")).alias("same_module"), "exported", "caller_server", "callee_server"))


@query("SELECT DISTINCT c_custkey AS user, c_mktsegment AS profile, r_name AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey".replace("AS user", 'AS "user"'))
def user_profiles(s, d):
    """Which profiles users have, and where."""
    n = t.table(s, d, "nation").join(t.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("profile"), F.col("r_name").alias("scope")).distinct()


@fact_query("""WITH n AS (SELECT 'orphan_nodes' AS name, count(*) AS violations FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) AND s_suppkey IS NOT NULL
UNION ALL SELECT 'module_without_aspect', count(*) FROM modules WHERE module NOT IN (SELECT p_size FROM part) UNION ALL SELECT 'form_without_aspect', count(*) FROM modules WHERE kind = 'form' AND owner IS NULL
UNION ALL SELECT 'subtype_kind_mismatch', count(*) FROM modules m JOIN nation ON n_nationkey = owner WHERE kind = 'common' UNION ALL SELECT 'ambiguous_without_candidates', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) < 2)
UNION ALL SELECT 'reference_xor_violation', count(*) FROM lineitem WHERE (l_partkey IS NULL) = (l_suppkey IS NULL) UNION ALL SELECT 'call_edge_without_ref', count(*) FROM calls WHERE file NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'blob_marked_but_referenced', count(DISTINCT l.doc_id) FROM labels l JOIN documents dd ON dd.doc_id = l.doc_id WHERE quality = 0 UNION ALL SELECT 'blob_unmarked_and_unreferenced', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'object_data_edge_without_dep', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) e WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) SELECT name, CAST(violations AS BIGINT) AS violations FROM n""")
def integrity_checks(s, d):
    """Violations of the ten integrity rules; a sound store has none, the bindings of some rules do."""
    li, sup, docs, labels = (t.table(s, d, x) for x in ("lineitem", "supplier", "documents", "labels"))
    m, names = facts.modules(s, d), t.table(s, d, "part").groupBy("p_name").count()
    anti = lambda a, b, x, y: a.join(b.select(F.col(y).alias("_y")).distinct(), a[x] == F.col("_y"), "left_anti")
    edges = li.select("l_partkey", "l_suppkey").distinct()
    found = {
        "orphan_nodes": anti(sup, li, "s_suppkey", "l_suppkey"), "module_without_aspect": anti(m, t.table(s, d, "part"), "module", "p_size"), "form_without_aspect": m.where("kind = 'form' AND owner IS NULL"),
        "subtype_kind_mismatch": m.where("kind = 'common'").join(t.table(s, d, "nation"), F.col("n_nationkey") == F.col("owner")), "ambiguous_without_candidates": names.where("count < 2"),
        "reference_xor_violation": li.where("(l_partkey IS NULL) = (l_suppkey IS NULL)"), "call_edge_without_ref": anti(facts.calls(s, d), t.table(s, d, "orders"), "file", "o_orderkey"),
        "blob_marked_but_referenced": docs.join(labels.where("quality = 0"), "doc_id", "left_semi"), "blob_unmarked_and_unreferenced": docs.join(labels, "doc_id", "left_anti"), "object_data_edge_without_dep": anti(edges, sup, "l_suppkey", "s_suppkey"),
    }
    return findings.union(*[df.agg(F.lit(name).alias("name"), F.count("*").alias("violations")) for name, df in found.items()])
