"""Registered queries: lists of one parent, scalar functions, fragments and overlays, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import findings
from ..operators import relational as rel
from ..sources import facts
from ..sources import tables as t
from .lookups import fact_query
from .queries import NOW, query


@fact_query("SELECT m.file, symbol, s.name, CAST(row_number() OVER (PARTITION BY m.file ORDER BY symbol) AS INTEGER) AS place FROM symbols s JOIN modules m ON m.module = s.module")
def file_symbols(s, d):
    """Symbols of every file in the order of the source."""
    m = facts.modules(s, d).select("module", "file")
    place = F.row_number().over(W.partitionBy("file").orderBy("symbol"))
    return facts.symbols(s, d).join(m, "module").select("file", "symbol", "name", place.alias("place"))


@fact_query("SELECT symbol, s.name, m.file FROM symbols s JOIN modules m ON m.module = s.module WHERE m.file = 'src/m7/Module.bsl' AND norm LIKE 'r%'")
def file_symbol(s, d):
    """Symbols by file and name."""
    m = facts.modules(s, d).where("file = 'src/m7/Module.bsl'").select("module", "file")
    return facts.symbols(s, d).where(F.col("norm").startswith("r")).join(m, "module").select("symbol", "name", "file")


@query("SELECT l_orderkey AS symbol, l_linenumber AS ord, p_name AS name, p_type AS type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'")
def symbol_parameters(s, d):
    """Parameters of symbols with their places."""
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return t.table(s, d, "lineitem").where("l_returnflag = 'A'").join(p, "l_partkey").select(F.col("l_orderkey").alias("symbol"), F.col("l_linenumber").alias("ord"), "name", "type")


@fact_query("SELECT n_name AS object, m.file, m.name AS module, m.kind FROM modules m JOIN nation ON n_nationkey = m.owner")
def owner_files(s, d):
    """Files with the code of every object."""
    n = t.table(s, d, "nation").select(F.col("n_nationkey").alias("owner"), F.col("n_name").alias("object"))
    return facts.modules(s, d).join(n, "owner").select("object", "file", F.col("name").alias("module"), "kind")


@query("SELECT n_nationkey AS object, 'form' AS part, s_name AS name, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS INTEGER) AS place FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT c_nationkey, 'command', c_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) FROM customer")
def object_lists(s, d):
    """Forms and commands of objects in the order in which they are shown."""
    sup = t.table(s, d, "supplier").select(F.col("s_nationkey").alias("object"), F.lit("form").alias("part"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    c = t.table(s, d, "customer").select("c_nationkey", F.lit("command"), "c_name", "c_custkey")
    return sup.union(c).select("object", "part", "name", F.row_number().over(W.partitionBy("object", "part").orderBy("k")).alias("place"))


@query("SELECT event_id AS job, event_type AS name, user_id AS component FROM events WHERE event_type = 'error' AND user_id = 12")
def scheduled_jobs(s, d):
    """Jobs by component and name."""
    return t.table(s, d, "events").where("event_type = 'error' AND user_id = 12").select(F.col("event_id").alias("job"), F.col("event_type").alias("name"), F.col("user_id").alias("component"))


@fact_query("SELECT symbol, 'access' AS what, mode AS detail, CAST(count(*) AS BIGINT) AS n FROM accesses GROUP BY 1, 2, 3 UNION ALL SELECT l_partkey, 'query', l_linestatus, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3")
def symbol_facts(s, d):
    """Register accesses and queries of every symbol."""
    a = facts.accesses(s, d).groupBy("symbol", F.lit("access").alias("what"), F.col("mode").alias("detail")).agg(F.count("*").alias("n"))
    q = t.table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", F.lit("query"), "l_linestatus").agg(F.count("*"))
    return a.union(q)


@query("SELECT source AS component, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (n_chars > 5000) AS BIGINT) AS diagnostics FROM documents GROUP BY 1 ORDER BY component LIMIT 100")
def component_list(s, d):
    """Components with their files and diagnostics."""
    return t.table(s, d, "documents").groupBy(F.col("source").alias("component")).agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 5000).alias("diagnostics")).orderBy("component").limit(100)


@query("""WITH e AS (SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'ext-a' ELSE 'base' END AS layer, l_returnflag AS kind FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT src, dst, layer, kind FROM e WHERE kind IN ('A', 'R') AND layer IN ('ext-a', 'base') ORDER BY src, dst, layer, kind LIMIT 1001""")
def layer_edges(s, d):
    """Edges of chosen layers and kinds, with one more row than the page holds."""
    e = t.table(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("kind")).distinct()
    e = e.select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), F.when(F.col("kind") == "R", "ext-a").otherwise("base").alias("layer"), "kind")
    return rel.keyset_page(e.where(F.col("kind").isin("A", "R") & F.col("layer").isin("ext-a", "base")), ["src", "dst", "layer", "kind"], None, 1000)


@query("""WITH f AS (SELECT o_orderkey AS file FROM orders WHERE o_orderstatus = 'P') SELECT l_partkey AS src, l_suppkey AS dst, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS files FROM lineitem WHERE l_orderkey IN (SELECT file FROM f) GROUP BY 1, 2""")
def edges_of_files(s, d):
    """Edges that depend on chosen files, with those files."""
    f = t.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    e = t.table(s, d, "lineitem").join(f, "l_orderkey", "left_semi").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return e.agg(F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ",").alias("files"))


@query(r"""SELECT page_id AS call, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS verb, s_name AS service FROM pages LEFT JOIN supplier ON s_suppkey = page_id""")
def http_calls(s, d):
    """Calls with the service that their file belongs to, if any."""
    sup = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("service"))
    return t.table(s, d, "pages").join(sup, "page_id", "left").select(F.col("page_id").alias("call"), F.regexp_extract("url", "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1).alias("verb"), "service")


@fact_query("SELECT callee, string_agg(DISTINCT caller::VARCHAR, ',' ORDER BY caller::VARCHAR) AS callers, m.name AS owner FROM calls JOIN symbols s ON s.symbol = callee JOIN modules m ON m.module = s.module WHERE norm IN ('red rod', 'blue rod', 'hot gear') GROUP BY 1, 3")
def batch_callers(s, d):
    """Callers and owner of each of a list of symbols, in one pass."""
    asked = facts.symbols(s, d).where(F.col("norm").isin("red rod", "blue rod", "hot gear")).join(facts.modules(s, d).select("module", F.col("name").alias("owner")), "module").select(F.col("symbol").alias("callee"), "owner")
    return facts.calls(s, d).join(asked, "callee").groupBy("callee", "owner").agg(F.array_join(F.array_sort(F.collect_set(F.col("caller").cast("string"))), ",").alias("callers"))


@fact_query("SELECT m.name AS key, 'module' AS kind, module AS id FROM modules m UNION ALL SELECT m.name, 'common', module FROM modules m WHERE kind = 'common' UNION ALL SELECT s_name, 'register', s_suppkey FROM supplier UNION ALL SELECT n_name, 'object', n_nationkey FROM nation")
def environment(s, d):
    """Keys that a resolver looks up: modules, common modules, registers, objects."""
    m = facts.modules(s, d)
    row = lambda df, key, kind, i: df.select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"))
    return row(m, "name", "module", "module").union(row(m.where("kind = 'common'"), "name", "common", "module")).union(row(t.table(s, d, "supplier"), "s_name", "register", "s_suppkey")).union(row(t.table(s, d, "nation"), "n_name", "object", "n_nationkey"))


@fact_query("SELECT symbol, CASE WHEN component < 'Brand#2' THEN true WHEN component > 'Brand#4' THEN false ELSE m.kind <> 'form' END AS server FROM symbols s JOIN modules m ON m.module = s.module")
def caller_context(s, d):
    """Whether symbols run on the server, by directive or kind of module."""
    m = facts.modules(s, d).select("module", F.col("kind").alias("k"))
    directive = F.when(F.col("component") < "Brand#2", "server").when(F.col("component") > "Brand#4", "client").otherwise("")
    return facts.symbols(s, d).join(m, "module").select("symbol", findings.runs_on_server(F.col("k"), directive).alias("server"))


@query("""WITH o AS (SELECT l_suppkey AS layer, p_type AS mtype, p_name AS name, min(l_orderkey) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
SELECT a.mtype, a.name, b.layer AS extension, CAST(row_number() OVER (PARTITION BY a.mtype, a.name ORDER BY b.layer) AS INTEGER) AS place FROM o a JOIN o b ON a.mtype = b.mtype AND a.name = b.name AND a.layer = 0 AND b.layer <> 0""")
def overlay(s, d):
    """Objects of the base that extensions borrow, by name and type, in the order of application."""
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("mtype"), F.col("p_name").alias("name"))
    o = t.table(s, d, "lineitem").join(p, "l_partkey").select(F.col("l_suppkey").alias("layer"), "mtype", "name").distinct()
    base, other = o.where("layer = 0").drop("layer"), o.where("layer <> 0").withColumnRenamed("layer", "extension")
    return base.join(other, ["mtype", "name"]).select("mtype", "name", "extension", F.row_number().over(W.partitionBy("mtype", "name").orderBy("extension")).alias("place"))


@query("SELECT doc_id, sha256(text) AS hash, substr(text, 11, 40) AS fragment FROM documents WHERE length(text) >= 50")
def source_fragments(s, d):
    """Fragments of sources by hash and range."""
    return t.table(s, d, "documents").where(F.length("text") >= 50).select("doc_id", F.sha2("text", 256).alias("hash"), F.substring("text", 11, 40).alias("fragment"))


@query("SELECT p_type AS owner, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS members, CAST(min(length(p_name) - length(replace(p_name, ' ', ''))) AS INTEGER) AS least, CAST(max(length(p_name)) AS INTEGER) AS longest FROM part WHERE starts_with(p_type, 'S') OR starts_with(p_type, 'P') GROUP BY 1")
def owner_members(s, d):
    """Members of owners whose names begin so, with the least arity."""
    p = t.table(s, d, "part").where(F.col("p_type").startswith("S") | F.col("p_type").startswith("P"))
    return p.groupBy(F.col("p_type").alias("owner")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("members"), F.min(F.length("p_name") - F.length(F.replace("p_name", F.lit(" "), F.lit("")))).alias("least"), F.max(F.length("p_name")).alias("longest"))


@query("SELECT p_name AS name, p_type AS owner, min(p_partkey) AS id FROM part GROUP BY 1, 2")
def entry_dedupe(s, d):
    """Entries of a reference once each, by what identifies them."""
    return t.table(s, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("owner")).agg(F.min("p_partkey").alias("id"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'done' END AS state, count(*) FILTER (l.doc_id IS NULL) OVER () AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def card_tasks(s, d):
    """Outputs matched with their inputs, and how many are missing."""
    both = t.table(s, d, "documents").select("doc_id").join(t.table(s, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    missing = both.agg(F.count_if(F.col("l").isNull()).alias("missing"))
    return both.select("doc_id", F.when(F.col("l").isNull(), "missing").otherwise("done").alias("state")).join(F.broadcast(missing))  # one row


@query(r"""SELECT doc_id, CASE WHEN h % 10 < 8 THEN 'dev' ELSE 'test' END AS split, regexp_replace(left(text, 80), '[0-9]', '#', 'g') AS masked FROM (SELECT *, CAST('0x' || left(sha256(text), 6) AS INTEGER) AS h FROM documents)""")
def eval_split(s, d):
    """A split of a dataset by a hash of its text, with digits masked."""
    h = F.conv(F.left(F.sha2("text", 256), F.lit(6)), 16, 10).cast("long")
    return t.table(s, d, "documents").select("doc_id", F.when(h % 10 < 8, "dev").otherwise("test").alias("split"), F.regexp_replace(F.left("text", F.lit(80)), "[0-9]", "#").alias("masked"))


@query(r"""SELECT p_partkey AS id, lower(p_name) || 'й' AS name, 'src/' || lower(replace(p_name, ' ', '/')) || '/module' AS path, p_name || ' "x" ' || chr(10) || p_type AS literal, 'a = "//' || p_name || '"; ' AS code FROM part""")
def normal_names(s, d):
    """Names, paths, literals and code in the forms that are compared."""
    n = F.col("p_name")
    path = F.concat(F.lit(".\\src//"), F.replace(n, F.lit(" "), F.lit("\\")), F.lit("/Module.bsl"))
    literal = F.concat(n, F.lit(' ""x"" \n   |'), "p_type")
    code = F.concat(F.lit('a = "//'), n, F.lit('"; // comment "'))
    return t.table(s, d, "part").select(F.col("p_partkey").alias("id"), text.normal_name(F.concat(n, F.lit("\u0418\u0306"))).alias("name"), text.module_path(path).alias("path"), text.unescaped(literal).alias("literal"), text.without_comments(code).alias("code"))


@query(r"""SELECT p_partkey AS id, CAST(3 AS INTEGER) AS n, 'f(' || p_size || ', "a,(b")' AS second, p_size % 2 = 0 AS closed, 'Function ' || replace(p_name, ' ', '_') || '(Val a, b = ' || p_size || ')' AS heading, 'Массив,' || CASE WHEN p_size < 25 THEN 'Строка' ELSE 'Thing' END AS types FROM part""")
def call_texts(s, d):
    """Arguments, brackets, headings and types of calls."""
    size = F.col("p_size").cast("string")
    args = F.concat(F.lit('x, f('), size, F.lit(', "a,(b"), g((1), 2)'))
    params = F.array(F.struct(F.lit("a").alias("name"), F.lit(True).alias("by_value"), F.lit(None).cast("string").alias("default")), F.struct(F.lit("b").alias("name"), F.lit(False).alias("by_value"), size.alias("default")))
    types = F.transform(text.type_tokens(F.concat(F.lit("Array of "), F.when(F.col("p_size") < 25, "String").otherwise("Thing"))), text.local_type)
    found = text.top_arguments(args)
    closed = text.balanced(F.concat(F.lit('f("(" + (1)'), F.when(F.col("p_size") % 2 == 0, ")").otherwise("")))
    return t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.size(found).alias("n"), F.get(found, F.lit(1)).alias("second"), closed.alias("closed"), text.signature(F.replace("p_name", F.lit(" "), F.lit("_")), params, F.lit(True)).alias("heading"), F.array_join(types, ",").alias("types"))


@query(r"""SELECT doc_id, CAST(length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')) + 1 AS INTEGER) AS line, CAST(100 - length(left(text, 100)) + length(string_split(left(text, 100), chr(10))[-1]) + 1 AS INTEGER) AS "column" FROM documents WHERE length(text) >= 100""")
def offsets(s, d):
    """Line and column of an offset in every text."""
    return t.table(s, d, "documents").where(F.length("text") >= 100).select("doc_id", F.inline(F.array(text.line_and_column(F.col("text"), F.lit(100)))))


@query(f"SELECT event_id, date_diff('day', ts, TIMESTAMP '{NOW}') AS days, date_diff('day', ts, TIMESTAMP '{NOW}') >= 7 AS stale, event_type = 'error' AS filled FROM events")
def export_ages(s, d):
    """Age of exports in days, and whether their ids are filled."""
    u = F.when(F.col("event_type") == "error", F.concat(F.lit("1000000a-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))).otherwise("00000000-0000-0000-0000-000000000000")
    return t.table(s, d, "events").select("event_id", F.inline(F.array(text.export_age(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")))), text.filled_uuid(u).alias("filled"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(l AS BIGINT) AS steps FROM orders JOIN (SELECT l_orderkey, count(*) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def evidence_round_trip(s, d):
    """Properties and evidence written as JSON and read again."""
    n = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("steps"))
    o = t.table(s, d, "orders").join(n, "o_orderkey").select("o_orderkey", F.to_json(F.struct(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("props"), "steps")).alias("j"))
    x = o.select(F.col("o_orderkey").alias("id"), F.from_json("j", "props map<string,string>, steps array<int>").alias("x"))
    return x.select("id", F.col("x.props")["status"].alias("status"), F.col("x.props")["priority"].alias("priority"), F.size("x.steps").cast("long").alias("steps"))
