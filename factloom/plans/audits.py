"""Registered queries of the audits, routes, generations and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import advice, audits, graph, routes, search
from ..operators import relational as rel
from ..sources import tables as t
from ..sources.shared import parted
from ..streaming import logs
from .queries import _EDGES, query


@query(r"""WITH c AS (SELECT page_id AS id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
e(endpoint, re, literals, tail) AS (VALUES ('E1', '^/+en/+[^/]+/*$', 1, 0), ('E2', '^/+[^/]+/+825/*$', 1, 0), ('E3', '', 0, 1), ('E4', '^/+de(/|$)', 1, 1), ('E5', '^/+en/+853/*$', 2, 0))
SELECT id, (SELECT arg_min(endpoint, (-literals, tail, endpoint)) FROM e WHERE regexp_matches(c.p, re)) AS endpoint FROM c""")
def path_templates(s, d):
    """The endpoint whose path template fits a call best."""
    e = s.createDataFrame([("E1", "/en/{id}"), ("E2", "/{lang}/825"), ("E3", "/*"), ("E4", "/de/*"), ("E5", "/en/853")], "endpoint string, pattern string")
    return routes.matched_templates(t.table(s, d, "pages").select(F.col("page_id").alias("id"), "url"), e)


@query(r"""WITH c AS (SELECT page_id AS id, CASE WHEN starts_with(url, 'https') THEN 'POST' ELSE 'GET' END AS verb, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
e(endpoint, re, literals, tail, verb) AS (VALUES ('E1', '^/+en/+[^/]+/*$', 1, 0, 'GET'), ('E2', '^/+[^/]+/+825/*$', 1, 0, '*'), ('E3', '', 0, 1, 'POST'), ('E4', '^/+de(/|$)', 1, 1, 'GET'))
SELECT id, (SELECT arg_min(endpoint, (-literals, tail, endpoint)) FROM e WHERE regexp_matches(c.p, re) AND e.verb IN ('*', c.verb)) AS endpoint FROM c""")
def verb_templates(s, d):
    """The endpoint whose path template and verb fit a call best."""
    e = s.createDataFrame([("E1", "/en/{id}", "GET"), ("E2", "/{lang}/825", "*"), ("E3", "/*", "POST"), ("E4", "/de/*", "GET")], "endpoint string, pattern string, verb string")
    verb = F.when(F.col("url").startswith("https"), "POST").otherwise("GET")
    return routes.matched_templates(t.table(s, d, "pages").select(F.col("page_id").alias("id"), "url", verb.alias("verb")), e)


@query(r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) AS host FROM pages),
r(rule, project) AS (VALUES ('m.therou.example.com', 'exact'), ('*.example.com', 'com'), ('*.example.net', 'net'), ('*ion.example.net', 'ion'))
SELECT host, coalesce((SELECT project FROM r WHERE rule = host), (SELECT arg_max(project, length(rule)) FROM r WHERE starts_with(rule, '*') AND ends_with(host, substr(rule, 2)))) AS project FROM h""")
def host_rules(s, d):
    """The project of every host: an exact rule, else the longest suffix."""
    r = s.createDataFrame([("m.therou.example.com", "exact"), ("*.example.com", "com"), ("*.example.net", "net"), ("*ion.example.net", "ion")], "rule string, project string")
    return routes.mapped_hosts(t.table(s, d, "pages").select(text.host(F.col("url")).alias("host")), r)


#: Parts whose texts one task reads: few bytes each, but long texts.
PART = 20_000

# Invented queries in the dialect of the application's language with the rules that each breaks, by kind of part.
_TEXTS = {
    "ECONOMY": ("ВЫБРАТЬ РАЗЛИЧНЫЕ ПЕРВЫЕ 5 * ИЗ Справочник.Товары КАК Т ГДЕ Т.Имя = \"ПОЛНОЕ СОЕДИНЕНИЕ (\"", ["SelectStar"]),
    "MEDIUM": ("ВЫБРАТЬ КОЛИЧЕСТВО(*) ИЗ Документ.Заказ КАК З ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Товары КАК Т ПО З.Товар = Т.Ссылка", ["OuterJoinWithoutIsNull"]),
    "STANDARD": ("ВЫБРАТЬ А.Б ИЗ Док.А КАК А ПОЛНОЕ ВНЕШНЕЕ СОЕДИНЕНИЕ (ВЫБРАТЬ В.Г ИЗ Док.В КАК В) КАК В ПО ИСТИНА ОБЪЕДИНИТЬ ВЫБРАТЬ ЕСТЬNULL(Т.Код, 0)", ["FullOuterJoin", "JoinWithSubquery", "UnionWithoutAll"]),
    "LARGE": ("ВЫБРАТЬ СУММА( 1 ) ИЗ РегистрНакопления.Остатки.Остатки КАК О ГДЕ О.Имя ПОДОБНО \"%лок\"", ["SumAsCount", "VirtualTableNoParams", "LeadingWildcardLike"]),
    "PROMO": ("ВЫБРАТЬ Д.Регистратор.Дата ИЗ РегистрНакопления.Запас.Остатки(&Дата) КАК Д СОЕДИНЕНИЕ Рег.Б.Обороты(&С, &По) КАК Б ПО ИСТИНА ГДЕ ГОД(Д.Период) = 2024", ["CompositeDereference", "VirtualTablesJoined", "FunctionOnFilterField"]),
    "SMALL": ("SELECT TOP 3 a.x FROM D.A AS a INNER JOIN D.B AS b JOIN D.C AS c ON b.y = c.y ON a.x = b.x WHERE a.x = 1 OR b.y = 2 AUTOORDER", ["NestedJoin", "OrAcrossFields", "TopWithAutoOrder"]),
}


@query("SELECT p_partkey AS id, unnest(CASE p_type " + " ".join(f"WHEN '{k}' THEN {rules!r}" for k, (_, rules) in _TEXTS.items()) + " END) AS rule FROM part")
def query_advice(s, d):
    """Rules that query texts break, one text for each part."""
    p, kind = t.table(s, d, "part").select("p_partkey", "p_type", "p_name"), F.col("p_type")
    p = parted(p, "p_partkey", p.count(), PART)
    own = F.element_at(F.create_map(*[F.lit(x) for k, (q, _) in _TEXTS.items() for x in (k, q)]), kind)
    return advice.query_advice(p.select(F.col("p_partkey").alias("id"), F.concat(own, F.lit(" // ПОЛНОЕ СОЕДИНЕНИЕ "), "p_name").alias("text")))


@query("SELECT p_partkey AS id, unnest(CASE p_type WHEN 'ECONOMY' THEN ['Т.ИМЯ'] WHEN 'SMALL' THEN ['A.X', 'B.Y'] ELSE [] END) AS field FROM part")
def unindexed_filters(s, d):
    """Fields of conditions that no index begins with."""
    p = t.table(s, d, "part")
    own = F.element_at(F.create_map(*[F.lit(x) for k, (q, _) in _TEXTS.items() for x in (k, q)]), F.col("p_type"))
    fields = s.createDataFrame([("Т.ИМЯ", False), ("A.X", False), ("B.Y", False), ("О.ИМЯ", True), ("Д.ПЕРИОД", True)], "field string, indexed boolean")
    return advice.unindexed_filters(p.select(F.col("p_partkey").alias("id"), own.alias("text")), fields)


@query(r"""WITH n AS (SELECT DISTINCT p_name AS name, lower(p_name) AS a FROM part), k AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, 9) r(i) WHERE starts_with(a, left('small ri', CAST(i AS INTEGER)))) AS shared FROM n)
SELECT name FROM k WHERE contains(a, 'small ri') OR contains('small ri', a) OR (shared >= 4 AND shared * 10 >= least(length(a), 8) * 7) ORDER BY name LIMIT 10""")
def similar_names(s, d):
    """Up to ten existing names close to one that was asked for."""
    return t.symbols(s, d).select("name").distinct().where(audits.similar(F.col("name"), "small ri")).orderBy("name").limit(10)


@query("""WITH g AS (SELECT o_orderpriority AS right, c_mktsegment AS role, bool_or(o_totalprice > 499000) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
roles AS (SELECT c_mktsegment AS role, bool_or(c_acctbal > 9990) AS for_new FROM customer GROUP BY 1), e AS (SELECT r.right, roles.role, CASE WHEN g.value THEN 'granted' WHEN g.value IS NULL AND for_new THEN 'undetermined' ELSE 'refused' END AS state
FROM (SELECT DISTINCT right FROM g) r CROSS JOIN roles LEFT JOIN g ON g.right = r.right AND g.role = roles.role)
SELECT right, coalesce(string_agg(CASE WHEN state = 'granted' THEN role END, ',' ORDER BY role), '') AS granted, coalesce(string_agg(CASE WHEN state = 'refused' THEN role END, ',' ORDER BY role), '') AS refused, coalesce(string_agg(CASE WHEN state = 'undetermined' THEN role END, ',' ORDER BY role), '') AS undetermined FROM e GROUP BY right""".replace("AS right", 'AS "right"').replace("r.right", 'r."right"').replace("g.right", 'g."right"').replace("DISTINCT right", 'DISTINCT "right"').replace("SELECT right", 'SELECT "right"').replace("BY right", 'BY "right"'))
def rights_pivot(s, d):
    """Roles that grant, refuse or leave open each right."""
    c = t.table(s, d, "customer")
    g = t.table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = g.select(F.col("o_orderpriority").alias("right"), F.col("c_mktsegment").alias("role"), (F.col("o_totalprice") > 499000).alias("value"))
    return audits.rights_pivot(g, c.groupBy(F.col("c_mktsegment").alias("role")).agg(F.bool_or(F.col("c_acctbal") > 9990).alias("for_new")))


@query("""WITH h AS (SELECT l_orderkey AS file, CASE WHEN l_partkey % 10 = 3 THEN 1 END AS hit FROM lineitem), a AS (SELECT CAST(count(hit) AS BIGINT) AS refs, CAST(count(*) AS BIGINT) AS all_refs, CAST(count(DISTINCT CASE WHEN hit = 1 THEN file END) AS BIGINT) AS files, CAST(count(DISTINCT file) AS BIGINT) AS all_files FROM h)
SELECT *, refs > greatest(5000.0, all_refs * 0.1) OR files > all_files / 2.0 AS "full" FROM a""")
def affected_set(s, d):
    """What a change of some keys affects, and whether to rebuild in full."""
    changed = t.table(s, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("key"))
    return audits.affected(changed, t.references(s, d).select(F.col("dst").alias("key"), F.col("src").alias("file")))


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS text, doc_id % 10 = 3 AS changed FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id + 1000000, text, true FROM documents WHERE doc_id % 50 = 1)
SELECT doc_id, sha256(text) AS digest, CASE WHEN changed THEN 2 ELSE 1 END AS generation FROM n""")
def published_generation(s, d):
    """The next generation of a table: rows of untouched files survive."""
    docs = t.table(s, d, "documents").select("doc_id", "text")
    sha = F.sha2("text", 256).alias("digest")
    old = docs.select("doc_id", sha, F.lit(1).alias("generation"))
    kept = docs.where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = kept.union(docs.where("doc_id % 50 = 1").select(F.col("doc_id") + 1000000, "text"))
    return audits.republished(old, new.select("doc_id", sha), "doc_id", "digest", 2)


@query("""SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind, round(max(1 - l_discount), 4) AS confidence, array_to_string(range(1, min(l_linenumber) + 1), '>') AS chain, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS files, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3""")
def edge_merge(s, d):
    """Edges merged from their evidence: a chain has as many steps as the number of its line."""
    chain = F.transform(F.sequence(F.lit(1), F.col("line")), lambda x: x.cast("string"))
    r = t.references(s, d).select(F.col("dst").alias("src"), F.col("owner").alias("dst"), "kind", "confidence", chain.alias("chain"), F.col("src").cast("string").alias("file"))
    return audits.merged_edges(r).withColumns({"chain": F.array_join("chain", ">"), "files": F.array_join("files", ",")})


@query("SELECT l_partkey AS target, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS extensions, 0.5::DOUBLE AS confidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def interceptor_conflicts(s, d):
    """Targets that several extensions replace."""
    mode = F.when(F.col("kind") == "R", "instead").otherwise("after")
    return audits.conflicts(t.references(s, d).select(F.col("dst").alias("target"), F.col("owner").alias("extension"), mode.alias("mode")))


@query("""WITH c AS (SELECT p_brand AS section, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS k, p_size FROM part), r AS (SELECT section, p_type, min(CASE WHEN p_size <= 5 AND k <= 50 THEN k END) AS rank FROM c GROUP BY 1, 2)
SELECT section, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits1, CAST(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS hits3, CAST(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS hits10, CAST(sum(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS hits20, CAST(sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits50, quantile_cont(rank, 0.5) AS median, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM r GROUP BY 1""")
def search_metrics(s, d):
    """Hits at 1 to 50, mean reciprocal and median rank of a ranking, per section."""
    top = rel.top_by(t.table(s, d, "part"), ["p_brand", "p_type"], 50, F.desc("p_retailprice"), F.col("p_partkey"))
    ranked = top.groupBy(F.col("p_brand").alias("section"), "p_type").agg(F.min(F.when(F.col("p_size") <= 5, F.col("rank"))).alias("rank"))
    return audits.retrieval_metrics(ranked)


@query("""WITH RECURSIVE c AS (SELECT source, doc_id AS id, n_chars AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w(source, k, id, used, ok) AS (SELECT source, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT c.source, c.k, c.id, CASE WHEN used + cost <= 20000 THEN used + cost ELSE used END, used + cost <= 20000 FROM w JOIN c ON c.source = w.source AND c.k = w.k + 1)
SELECT source, id, used FROM w WHERE ok""")
def context_pack(s, d):
    """Documents of every source that a budget admits greedily, in the order of their ids."""
    docs = t.table(s, d, "documents").select(F.col("source").alias("task"), F.lit("").alias("category"), F.col("doc_id").alias("id"), F.col("n_chars").alias("cost"), F.lit(0.0).alias("score"))
    return search.packed_context(docs, [], 20000).where("admitted").select(F.col("task").alias("source"), "id", "used")


@query(f"WITH {_EDGES}, s AS (SELECT DISTINCT src, dst, kind FROM edges WHERE layer <> 'base' EXCEPT SELECT src, dst, kind FROM edges WHERE layer = 'base'), ends AS (SELECT dst AS id, 1 AS i, 0 AS o FROM s UNION ALL SELECT src, 0, 1 FROM s) SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM ends GROUP BY id")
def diff_degrees(s, d):
    """Degrees over the relations that extensions add."""
    e = t.edges(s, d)
    keys = ["src", "dst", "kind"]
    return graph.degrees(e.where("layer <> 'base'").select(keys).distinct().join(e.where("layer = 'base'").select(keys), keys, "left_anti"))


@query(f"WITH {_EDGES} SELECT src, dst, kind, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, bool_and(layer <> 'base') AS added FROM edges GROUP BY 1, 2, 3")
def layer_projection(s, d):
    """Relations merged over layers, with the layers that have them."""
    layers = F.array_join(F.array_sort(F.collect_set("layer")), ",")
    return t.edges(s, d).groupBy("src", "dst", "kind").agg(layers.alias("layers"), F.bool_and(F.col("layer") != "base").alias("added"))


@query(" UNION ALL ".join(f"SELECT '{m}' AS mtype, CAST(count(*) AS BIGINT) AS n FROM {m}" for m in ("region", "nation", "customer", "supplier", "part")))
def object_counts(s, d):
    """Number of objects of every kind."""
    return t.objects(s, d).groupBy("mtype").agg(F.count("*").alias("n"))


@query("""SELECT 'NotInAnyPlan' AS rule, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'NoRegistration', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def exchange_audit(s, d):
    """Objects in no plan, and planned ones that nothing registers."""
    o = t.table(s, d, "orders")
    plan = t.table(s, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("NotInAnyPlan").alias("rule"), F.col("c_custkey").alias("id"))
    return plan.union(o.join(t.table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("NoRegistration"), "o_orderkey"))


@query("""WITH r AS (SELECT l_partkey AS command, c_mktsegment AS role, NOT bool_or(c_acctbal < 0) AS override FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
c AS (SELECT p_partkey AS command, CASE WHEN p_size < 10 THEN false WHEN p_size < 20 THEN true END AS common FROM part)
SELECT c.command, role, coalesce(override, common, true) AS visible, CASE WHEN override IS NOT NULL THEN 'role' WHEN common IS NOT NULL THEN 'common' ELSE 'default' END AS "by" FROM c LEFT JOIN r ON c.command = r.command""")
def command_visibility(s, d):
    """Whether commands are shown: a role's setting, else the common one, else yes."""
    o = t.table(s, d, "orders").join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_mktsegment").alias("role"), (F.col("c_acctbal") < 0).alias("hidden"))
    r = t.table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("command")).join(o, "l_orderkey").groupBy("command", "role").agg((~F.bool_or("hidden")).alias("override"))
    c = t.table(s, d, "part").select(F.col("p_partkey").alias("command"), F.when(F.col("p_size") < 10, False).when(F.col("p_size") < 20, True).alias("common"))
    by = F.when(F.col("override").isNotNull(), "role").when(F.col("common").isNotNull(), "common").otherwise("default")
    return c.join(r, "command", "left").select("command", "role", F.coalesce("override", "common", F.lit(True)).alias("visible"), by.alias("by"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY user_id, burst""")
def bursts(s, d):
    """Changes of a user coalesced while less than two hours are between them."""
    e = t.table(s, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, min(ts) AS first, max(ts) AS last FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def log_stream_hours(s, d):
    """The log as a stream: hours that the watermark has closed, by type."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return logs.run_available(logs.hours(logs.entries(s, f"{d}/events.parque[t]", schema, "10 minutes")))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, TRY_CAST(CAST(value AS VARCHAR) AS BIGINT) IS NULL AS fractional, lower(event_type) IN ('purchase', 'signup') AS flag FROM events".replace("TRY_CAST(CAST(value AS VARCHAR) AS BIGINT) IS NULL", "value <> floor(value)"))
def loose_cells(s, d):
    """Cells of a query result coerced to numbers and flags."""
    e = t.table(s, d, "events")
    return e.select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"), F.lit(0)).alias("k"), (F.col("value") != F.floor("value")).alias("fractional"), F.lower("event_type").isin("purchase", "signup").alias("flag"))


@query("SELECT CAST(a.n AS BIGINT) AS before, CAST(b.n AS BIGINT) AS after, b.n * 10 < a.n AS collapsed FROM (SELECT count(*) AS n FROM part) a, (SELECT count(*) AS n FROM part WHERE p_size = 1) b")
def collapse_guard(s, d):
    """Whether a new generation lost nine tenths of its symbols; both are counted in one pass."""
    n = t.table(s, d, "part").agg(F.count("*").alias("before"), F.count(F.when(F.col("p_size") == 1, 1)).alias("after"))
    return n.withColumn("collapsed", F.col("after") * 10 < F.col("before"))
