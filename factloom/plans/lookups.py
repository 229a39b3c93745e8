"""Registered queries: lookups, filters, joins and lists over facts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..sources import facts
from ..sources import tables as t
from ..sources.facts import with_facts
from .queries import query

#: A list of names without a bound, as a caller would hand it over.
ASKED = [f"{a} {b}" for a in ("red", "blue", "cold") for b in ("rod", "gear", "anvil", "nothing")]


def fact_query(sql: str):
    return query(with_facts(sql))


@fact_query("SELECT symbol, s.name, m.name AS module, m.file, s.kind FROM symbols s JOIN modules m ON s.module = m.module")
def symbol_rows(s, d):
    """Symbols with their module and file."""
    m = facts.modules(s, d).select("module", F.col("name").alias("module_name"), "file")
    return facts.symbols(s, d).join(m, "module").select("symbol", "name", F.col("module_name").alias("module"), "file", "kind")


@fact_query("SELECT caller, callee, m.file, line, c.kind FROM calls c JOIN symbols s ON s.symbol = caller JOIN modules m ON s.module = m.module WHERE resolution = 'resolved'")
def reference_rows(s, d):
    """Resolved references with the file that they stand in."""
    c = facts.calls(s, d).where("resolution = 'resolved'")
    where = facts.symbols(s, d).join(facts.modules(s, d).select("module", "file"), "module").select(F.col("symbol").alias("caller"), F.col("file").alias("path"))
    return c.drop("file").join(where, "caller").select("caller", "callee", F.col("path").alias("file"), "line", "kind")


@fact_query("SELECT symbol, norm, kind FROM symbols WHERE norm = 'red rod' ORDER BY symbol")
def exact_name(s, d):
    """Symbols of exactly this name."""
    return facts.symbols(s, d).where("norm = 'red rod'").select("symbol", "norm", "kind").orderBy("symbol")


@query("SELECT 'nation:' || n_nationkey AS id, 'nation' AS mtype, n_name AS name, r_name AS synonym FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name), '1') OR contains(lower(r_name), 'a') ORDER BY mtype, id")
def name_or_synonym(s, d):
    """Objects whose name or synonym holds a text, in any case."""
    o = t.objects(s, d).where("mtype = 'nation'").join(t.table(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), "n_regionkey"), "id")
    o = o.join(t.table(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("synonym")), "n_regionkey")
    return o.where(rel.holds(F.col("name"), "1") | rel.holds(F.col("synonym"), "A")).select("id", "mtype", "name", "synonym").orderBy("mtype", "id")


@query("SELECT event_id, props FROM events WHERE props LIKE '%\": 1%' OR props LIKE '%!_%' ESCAPE '!'")
def literal_like(s, d):
    """Log entries that hold texts whose signs a pattern would take for wildcards."""
    return t.table(s, d, "events").where(rel.holds(F.col("props"), '": 1') | rel.holds(F.col("props"), "_")).select("event_id", "props")


@fact_query("SELECT symbol, name FROM symbols WHERE norm IN (" + ", ".join(f"'{x}'" for x in ASKED) + ")")
def in_list(s, d):
    """Symbols named in a list of any length."""
    asked = s.createDataFrame([(x,) for x in ASKED], "norm string")
    return rel.in_list(facts.symbols(s, d), asked, "norm").select("symbol", "name")


@fact_query("SELECT symbol, register, mode, static, confidence FROM accesses WHERE register IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND mode IN ('write', 'clear') AND static AND confidence >= 0.95")
def access_filter(s, d):
    """Accesses to registers by mode, certainty and least confidence."""
    some = t.table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("register"))
    found = facts.accesses(s, d).where(rel.all_of(F.col("mode").isin("write", "clear"), F.col("static"), F.col("confidence") >= 0.95))
    return found.join(some, "register", "left_semi").select("symbol", "register", "mode", "static", "confidence")


@query("SELECT o_orderkey AS query, l_partkey AS object, l_returnflag AS kind, l_linenumber AS member FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linenumber = 2 AND o_orderpriority = '1-URGENT'")
def query_references(s, d):
    """References of queries to objects, by kind, member and name."""
    q = t.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("query"))
    r = t.references(s, d).where("kind = 'R' AND line = 2").select(F.col("src").alias("query"), F.col("dst").alias("object"), "kind", F.col("line").alias("member"))
    return q.join(r, "query").select("query", "object", "kind", "member")


@query("""WITH p AS (SELECT page_id, trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/') AS region FROM pages)
SELECT page_id, region FROM p WHERE region = 'en' OR starts_with(region, 'en/') OR region = 'de' OR starts_with(region, 'de/')""")
def region_filter(s, d):
    """Pages in one of several regions or below it."""
    p = t.table(s, d, "pages").select("page_id", F.array_join(text.segments(F.col("url")), "/").alias("region"))
    return p.where(rel.within(F.col("region"), ["en", "de"]))


@query("""WITH o AS (SELECT 'nation' AS mtype, n_name AS name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part)
SELECT mtype, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM o WHERE mtype <> 'part' AND contains(lower(name), '1') GROUP BY 1""")
def metadata_tree(s, d):
    """Groups of objects by type with the names that hold a text; empty groups go."""
    o = t.objects(s, d).where(F.col("mtype").isin("nation", "supplier") & rel.holds(F.col("name"), "1"))
    return o.groupBy("mtype").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("SELECT o_orderkey AS object, string_agg(l_partkey::VARCHAR || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def object_parts(s, d):
    """The lines of every object as one ordered section, without its other sections."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    o = t.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(t.table(s, d, "lineitem").select("l_orderkey", line.alias("x")), "l_orderkey")
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["p"].cast("string"), x["n"].cast("string")))
    return o.groupBy(F.col("l_orderkey").alias("object")).agg(F.array_join(lines, ",").alias("lines"))


@query(r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}])than') AS than, regexp_matches(lower(text), '(^|[^\p{L}\p{N}])que') AS que FROM documents")
def word_starts(s, d):
    """Whether a word of the text begins with a stem; inside a word it doesn't count."""
    return t.table(s, d, "documents").select("doc_id", text.word_start(F.col("text"), "than").alias("than"), text.word_start(F.col("text"), "que").alias("que"))


@fact_query("SELECT callee AS id, c.kind, m.name || '.' || s.name AS display, confidence, 'resolved' AS detail FROM calls c JOIN symbols s ON s.symbol = c.caller JOIN modules m ON m.module = s.module WHERE resolution = 'resolved'")
def callers_into(s, d):
    """Call edges into each callee, with the caller shown as module and symbol."""
    m = facts.modules(s, d).select("module", F.col("name").alias("m"))
    shown = facts.symbols(s, d).join(m, "module").select(F.col("symbol").alias("caller"), F.concat_ws(".", "m", "name").alias("display"))
    return facts.calls(s, d).where("resolution = 'resolved'").join(shown, "caller").select(F.col("callee").alias("id"), "kind", "display", "confidence", F.col("resolution").alias("detail"))


@query("SELECT l_partkey AS id, s_name AS display, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey IS NOT NULL GROUP BY 1, 2")
def references_into(s, d):
    """References into each object, by who refers."""
    named = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("owner"), F.col("s_name").alias("display"))
    return t.references(s, d).where("dst IS NOT NULL").join(named, "owner").groupBy(F.col("dst").alias("id"), "display").agg(F.count("*").alias("n"))


@fact_query("SELECT symbol AS id, n_name || '.' || m.name AS display, 1.0::DOUBLE AS confidence, 'handler' AS kind FROM symbols s JOIN modules m ON s.module = m.module JOIN nation ON n_nationkey = m.owner WHERE m.kind = 'form'")
def handler_edges(s, d):
    """Handlers of forms: bindings joined with the form and its owner; their confidence is one."""
    m = facts.modules(s, d).where("kind = 'form'").select("module", F.col("name").alias("m"), F.col("owner").alias("n_nationkey"))
    named = m.join(t.table(s, d, "nation"), "n_nationkey")
    return facts.symbols(s, d).join(named, "module").select(F.col("symbol").alias("id"), F.concat_ws(".", "n_name", "m").alias("display"), F.lit(1.0).alias("confidence"), F.lit("handler").alias("kind"))


@fact_query("SELECT register AS id, m.name || '.' || s.name AS display, mode || CASE WHEN static THEN ' (static)' ELSE ' (dynamic)' END AS detail, a.confidence FROM accesses a JOIN symbols s ON s.symbol = a.symbol JOIN modules m ON m.module = s.module")
def access_edges(s, d):
    """Register accesses as edges into the register, with mode and certainty."""
    shown = facts.symbols(s, d).join(facts.modules(s, d).select("module", F.col("name").alias("m")), "module").select("symbol", F.concat_ws(".", "m", "name").alias("display"))
    detail = F.concat("mode", F.when(F.col("static"), " (static)").otherwise(" (dynamic)"))
    return facts.accesses(s, d).join(shown, "symbol").select(F.col("register").alias("id"), "display", detail.alias("detail"), "confidence")


@fact_query("SELECT role, object, name || '=' || CASE WHEN bool_or(value) THEN 'yes' ELSE 'no' END || CASE WHEN bool_or(restricted) THEN '+RLS' ELSE '' END AS detail FROM grants GROUP BY role, object, name")
def role_details(s, d):
    """Rights of roles on objects in one text each."""
    g = facts.grants(s, d).groupBy("role", "object", "name").agg(F.bool_or("value").alias("v"), F.bool_or("restricted").alias("r"))
    return g.select("role", "object", F.concat("name", F.lit("="), F.when(F.col("v"), "yes").otherwise("no"), F.when(F.col("r"), "+RLS").otherwise("")).alias("detail"))


@query("""SELECT c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_name <> 'NATION_3' LEFT JOIN region ON r_regionkey = n_regionkey""")
def dependency_rows(s, d):
    """Dependencies with what they name, where it is known."""
    n = t.table(s, d, "nation").where("n_name <> 'NATION_3'").join(t.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.table(s, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@fact_query("SELECT symbol, s.name, m.name AS module, n_name AS owner FROM symbols s LEFT JOIN modules m ON s.module = m.module AND m.kind = 'object' LEFT JOIN nation ON n_nationkey = m.owner WHERE exported")
def exported_methods(s, d):
    """Exported methods with their owner and module, if any."""
    m = facts.modules(s, d).where("kind = 'object'").select("module", F.col("name").alias("m"), "owner")
    named = m.join(t.table(s, d, "nation").select(F.col("n_nationkey").alias("owner"), "n_name"), "owner", "left")
    return facts.symbols(s, d).where("exported").join(named, "module", "left").select("symbol", "name", F.col("m").alias("module"), F.col("n_name").alias("owner"))


@fact_query("SELECT callee, CAST(count(*) AS BIGINT) AS calls, CAST(count(DISTINCT a.module) AS BIGINT) AS modules FROM calls JOIN symbols a ON a.symbol = caller JOIN symbols b ON b.symbol = callee WHERE a.module <> b.module GROUP BY callee")
def external_calls(s, d):
    """Calls of every symbol from other modules than its own."""
    a = facts.symbols(s, d).select(F.col("symbol").alias("caller"), F.col("module").alias("from"))
    b = facts.symbols(s, d).select(F.col("symbol").alias("callee"), F.col("module").alias("to"))
    return facts.calls(s, d).join(a, "caller").join(b, "callee").where(F.col("from") != F.col("to")).groupBy("callee").agg(F.count("*").alias("calls"), F.countDistinct("from").alias("modules"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp, CASE WHEN l_returnflag = 'R' THEN 'ext-a' ELSE 'base' END AS layer FROM lineitem)
SELECT s_nationkey AS mtype, min(s_suppkey) AS id, CAST(count(DISTINCT part) AS BIGINT) AS degree FROM e JOIN supplier ON supp = s_suppkey GROUP BY 1""")
def canonical_degrees(s, d):
    """Degrees over all layers of objects that count as one, named by the smallest id."""
    e = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    o = t.table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("mtype"))
    return e.join(o, "s_suppkey").groupBy("mtype").agg(F.min("s_suppkey").alias("id"), F.countDistinct("part").alias("degree"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)")
def edges_between(s, d):
    """Distinct edges whose two ends are in given sets."""
    e = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    a = t.table(s, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("src"))
    b = t.table(s, d, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("dst"))
    return e.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst").distinct()


@query("""WITH o AS (SELECT doc_id, sha256(text) AS hash, n_chars AS size FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(text) AS hash, n_chars + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'unknown' WHEN n.doc_id IS NULL THEN 'gone' WHEN n.size <> o.size THEN 'changed' ELSE 'known' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def corpus_state(s, d):
    """Files of a listing against the corpus: known, changed by size, unknown or gone."""
    docs = t.table(s, d, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.col("n_chars").alias("old"))
    new = docs.where("doc_id % 5 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)).alias("new"))
    state = F.when(F.col("old").isNull(), "unknown").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed").otherwise("known")
    return old.join(new, "doc_id", "full").select("doc_id", state.alias("state"))


@query("""SELECT l_orderkey AS src, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS members, CAST(count(DISTINCT p_name) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def ordered_members(s, d):
    """Groups with their members once each, in order."""
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("dst"), "p_name")
    g = t.references(s, d).join(p, "dst").groupBy("src").agg(F.array_sort(F.collect_set("p_name")).alias("m"))
    return g.select("src", F.array_join("m", ",").alias("members"), F.size("m").cast("long").alias("n"))


@fact_query("SELECT register, CAST(count(DISTINCT CASE WHEN NOT static THEN symbol END) AS BIGINT) AS dynamic, CAST(count(DISTINCT CASE WHEN confidence < 0.92 THEN symbol END) AS BIGINT) AS weak, CAST(count(DISTINCT symbol) AS BIGINT) AS all FROM accesses GROUP BY register".replace("AS all", 'AS "all"'))
def badges(s, d):
    """Counts of distinct facts of every owner: dynamic, weak and all."""
    a = facts.accesses(s, d)
    return a.groupBy("register").agg(F.countDistinct(F.when(~F.col("static"), F.col("symbol"))).alias("dynamic"), F.countDistinct(F.when(F.col("confidence") < 0.92, F.col("symbol"))).alias("weak"), F.countDistinct("symbol").alias("all"))


@query("""WITH w AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN event_id END AS bound FROM events)
SELECT user_id, ts, last_value(bound IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bound FROM w""")
def rebindings(s, d):
    """The last assignment to a variable before each of its uses."""
    e = t.table(s, d, "events").select("user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("b"))
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return e.select("user_id", "ts", F.last("b", ignorenulls=True).over(w).alias("bound"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS own FROM documents)
SELECT doc_id, line, last_value(CASE WHEN length(own) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS region FROM l""")
def innermost_region(s, d):
    """The heading that each line stands under."""
    lines = t.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "own"))
    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    line = (F.col("line") + 1).cast("long")
    return lines.select("doc_id", line.alias("line"), F.last(F.when(F.length("own") < 60, line), ignorenulls=True).over(w).alias("region"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 101")
def id_page(s, d):
    """A page by id with one more row, which says that there is another page."""
    return rel.keyset_page(t.table(s, d, "events").select("event_id", "event_type"), ["event_id"], (500,), 100)


@fact_query("SELECT symbol, score FROM (SELECT symbol, norm, greatest(CASE WHEN norm = 'cold rod' THEN 3 WHEN starts_with(norm, 'cold') THEN 2 WHEN contains(norm, 'cold') THEN 1 ELSE 0 END, CASE WHEN starts_with(lower(kind), 'prom') THEN 2 WHEN contains(lower(kind), 'o') THEN 1 ELSE 0 END) * 100 + module AS score FROM symbols) WHERE score >= 100 ORDER BY score DESC, length(norm), norm, symbol LIMIT 200")
def syntax_search(s, d):
    """Entries of a reference by the better of two names, then by importance and length."""
    rank = lambda c, *w: F.when(c == w[0], 3).when(c.startswith(w[1]), 2).when(c.contains(w[2]), 1).otherwise(0)
    score = F.greatest(rank(F.col("norm"), "cold rod", "cold", "cold"), rank(F.lower("kind"), "promo only", "prom", "o")) * 100 + F.col("module")
    return facts.symbols(s, d).select("symbol", "norm", score.alias("score")).where("score >= 100").orderBy(F.desc("score"), F.length("norm"), "norm", "symbol").limit(200).select("symbol", "score")


@query("SELECT doc_id, source, round(n_chars / 1000.0, 6) AS coverage FROM documents ORDER BY round(n_chars / 1000.0, 6) DESC, lang, source, doc_id LIMIT 50")
def relevance_order(s, d):
    """The first fifty by coverage to six digits, then by fit and name."""
    coverage = F.round(F.col("n_chars") / 1000.0, 6)
    return t.table(s, d, "documents").select("doc_id", "source", coverage.alias("coverage"), "lang").orderBy(F.desc("coverage"), "lang", "source", "doc_id").limit(50).drop("lang")


@query(f"""WITH a AS (SELECT DISTINCT l_partkey AS src, CASE WHEN l_returnflag = 'R' THEN 'ext-a' ELSE 'base' END AS layer FROM lineitem)
SELECT src, string_agg(layer, ',' ORDER BY CASE WHEN layer = 'base' THEN 0 ELSE 1 END, layer) AS layers FROM a GROUP BY 1""")
def layer_order(s, d):
    """The layers that name each object: the base first, then extensions in order of application."""
    a = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.when(F.col("l_returnflag") == "R", "ext-a").otherwise("base").alias("layer")).distinct()
    rank = F.struct(F.when(F.col("layer") == "base", 0).otherwise(1).alias("k"), F.col("layer").alias("layer"))
    return a.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["layer"]), ",").alias("layers"))


@query("""WITH g AS (SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS n, max(ts) AS last FROM events GROUP BY 1, 2) SELECT event_type, user_id, n, last FROM g ORDER BY n DESC, last DESC, event_type, user_id LIMIT 100""")
def log_order(s, d):
    """Groups of the log, the largest and latest first."""
    g = t.table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.orderBy(F.desc("n"), F.desc("last"), "event_type", "user_id").limit(100)


@query("""WITH a AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part WHERE p_brand < 'Brand#2'), b AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part WHERE p_brand >= 'Brand#2' AND p_type <> 'PROMO')
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name, CASE WHEN coalesce(a.kind, b.kind) NOT IN (SELECT kind FROM a INTERSECT SELECT kind FROM b) THEN 'not comparable' WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'common' END AS side
FROM a FULL JOIN b ON a.kind = b.kind AND a.name = b.name""")
def typed_difference(s, d):
    """Two snapshots compared type by type; a type that one side lacks is not comparable."""
    p = t.table(s, d, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), "p_brand")
    return rel.typed_difference(p.where("p_brand < 'Brand#2'"), p.where("p_brand >= 'Brand#2' AND kind <> 'PROMO'"), "kind", "name")


@query("""WITH wanted AS (SELECT n_nationkey AS place, 'orders' AS item FROM nation UNION ALL SELECT n_nationkey, 'suppliers' FROM nation), have AS (SELECT c_nationkey AS place, 'orders' AS item, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT s_nationkey, 'suppliers', count(*) FROM supplier GROUP BY 1)
SELECT w.place, w.item, CASE WHEN n IS NULL THEN 'not done' WHEN n < 5 THEN 'partial' ELSE 'done' END AS status FROM wanted w LEFT JOIN have h ON h.place = w.place AND h.item = w.item""")
def checklist(s, d):
    """What a reference places everywhere, and whether it is done, partly done or not."""
    n = t.table(s, d, "nation").select(F.col("n_nationkey").alias("place"))
    wanted = n.withColumn("item", F.explode(F.array(F.lit("orders"), F.lit("suppliers"))))
    o = t.table(s, d, "orders").join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("place"), F.lit("orders").alias("item"))
    have = o.union(t.table(s, d, "supplier").select("s_nationkey", F.lit("suppliers")))
    return rel.checklist(wanted, have, ["place", "item"], 5)


@query("SELECT lower(p_type) AS key, min_by(p_type, p_partkey) AS first, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def folded_union(s, d):
    """Names once each whatever their case, in the spelling that came first."""
    return rel.first_spelling(t.table(s, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("place")), "name", "place")
