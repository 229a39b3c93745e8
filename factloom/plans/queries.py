"""Registered queries: each a function of (spark, folder) and, where SQL has it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, search
from ..operators import relational as rel
from ..sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]

_EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'nation-region' AS kind, 'base' AS layer FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer-nation', 'base' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'supplier-nation', 'base' FROM supplier
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'part-supplier', CASE WHEN l_returnflag = 'R' THEN 'ext-a' ELSE 'base' END FROM lineitem)"""
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_EDGES}, ends AS (SELECT dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges)
SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM ends GROUP BY id ORDER BY sum(i) + sum(o) DESC, id LIMIT 20""")
def god_nodes(s, d):
    """The twenty objects with most edges."""
    return graph.degrees(t.edges(s, d)).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(20)


@query(f"""WITH {_EDGES}, real AS (SELECT DISTINCT src, dst, kind FROM edges), ends AS (SELECT dst AS id, 1 AS i, 0 AS o FROM real UNION ALL SELECT src, 0, 1 FROM real)
SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM ends GROUP BY id""")
def merged_degrees(s, d):
    """Degrees that count relations, not their rows in several layers."""
    return graph.degrees(t.edges(s, d).select("src", "dst", "kind").distinct())


@query("SELECT p_partkey AS id, lower(p_name) AS name_norm, p_type AS kind FROM part WHERE lower(p_name) LIKE '%a%' AND p_brand <> 'Brand#11' AND (lower(p_name), p_partkey) > ('b', 10) ORDER BY lower(p_name), p_partkey LIMIT 51")
def symbol_page(s, d):
    """A page of symbols by part of the name, after a key."""
    found = t.symbols(s, d).where(rel.all_of(F.col("name_norm").contains("a"), F.col("component") != "Brand#11"))
    return rel.keyset_page(found.select("id", "name_norm", "kind"), ["name_norm", "id"], ("b", 10), 50)


@query("""SELECT id, name_norm, tier FROM (SELECT p_partkey AS id, lower(p_name) AS name_norm, CASE WHEN lower(p_name) = 'almond' THEN 0 WHEN starts_with(lower(p_name), 'al') THEN 1 WHEN contains(lower(p_name), 'al') THEN 2 END AS tier FROM part)
WHERE tier IS NOT NULL ORDER BY tier, length(name_norm), name_norm, id LIMIT 100""")
def tiered_search(s, d):
    """Symbols by exact name, prefix, then part."""
    name = F.col("name_norm")
    tier = F.when(name == "almond", 0).otherwise(rel.tier(name, "al"))
    return t.symbols(s, d).select("id", "name_norm", tier.alias("tier")).where("tier IS NOT NULL").orderBy("tier", F.length("name_norm"), "name_norm", "id").limit(100)


@query("SELECT name, CAST(levenshtein(lower(name), 'almond antique') AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY 2, 1 LIMIT 10")
def near_names(s, d):
    """The ten names nearest to a misspelt one."""
    names = t.symbols(s, d).select("name").distinct()
    return names.select("name", F.levenshtein(F.lower("name"), F.lit("almond antique")).alias("distance")).orderBy("distance", "name").limit(10)


@query("SELECT l_partkey AS dst, l_returnflag AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS callers, round(min(1 - l_discount), 4) AS least FROM lineitem GROUP BY 1, 2")
def references_grouped(s, d):
    """References by target and kind."""
    return t.references(s, d).groupBy("dst", "kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("callers"), F.round(F.min("confidence"), 4).alias("least"))


@query("""WITH c AS (SELECT l_partkey AS dst, count(DISTINCT l_suppkey) AS owners, count(*) AS calls FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3)
SELECT dst, CAST(owners AS BIGINT) AS owners, CAST(calls AS BIGINT) AS calls, round(calls / (SELECT count(*) FROM lineitem), 8) AS share FROM c ORDER BY owners DESC, calls DESC, dst LIMIT 100""")
def core_methods(s, d):
    """Targets that three or more owners call, with their share of all calls."""
    r = t.references(s, d)
    total = r.agg(F.count("*").alias("total"))
    core = r.groupBy("dst").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("calls")).where("owners >= 3")
    return core.join(F.broadcast(total)).select("dst", "owners", "calls", F.round(F.col("calls") / F.col("total"), 8).alias("share")).orderBy(F.desc("owners"), F.desc("calls"), "dst").limit(100)


@query("""SELECT dst, src AS first_src, line FROM (SELECT l_partkey AS dst, l_orderkey AS src, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def first_call_sites(s, d):
    """The first reference to each target."""
    return t.references(s, d).groupBy("dst").agg(F.min(F.struct("src", "line")).alias("m")).select("dst", F.col("m.src").alias("first_src"), F.col("m.line").alias("line"))


@query("""WITH names AS (SELECT DISTINCT p_type AS scope, p_name AS name FROM part), calls AS (SELECT DISTINCT l_orderkey AS src, p_type AS scope, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
local AS (SELECT p_type AS scope, p_name AS name, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY 1, 2), anywhere AS (SELECT p_name AS name, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1)
SELECT c.src, c.scope, c.name, CASE WHEN l.n IS NOT NULL THEN 'local' WHEN g.n IS NOT NULL THEN 'global' ELSE 'none' END AS via,
CASE WHEN coalesce(l.n, g.n) IS NULL THEN 'unresolved' WHEN coalesce(l.n, g.n) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state
FROM calls c LEFT JOIN local l ON c.scope = l.scope AND c.name = l.name LEFT JOIN anywhere g ON c.name = g.name""")
def resolution_cascade(s, d):
    """Names resolved in their own scope, else anywhere: one is resolved, more are ambiguous."""
    part = t.table(s, d, "part")
    calls = t.table(s, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.col("p_type").alias("scope"), F.col("p_name").alias("name")).distinct()
    local = part.where("p_size <= 10").groupBy(F.col("p_type").alias("scope"), F.col("p_name").alias("name")).agg(F.count("*").alias("here"))
    anywhere = part.where("p_size > 40").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("there"))
    n = F.coalesce("here", "there")
    found = calls.join(local, ["scope", "name"], "left").join(anywhere, "name", "left")
    via = F.when(F.col("here").isNotNull(), "local").when(F.col("there").isNotNull(), "global").otherwise("none")
    return found.select("src", "scope", "name", via.alias("via"), F.when(n.isNull(), "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("state"))


_HEALTH = "SELECT '{0}' AS source, CAST(count(*) AS BIGINT) AS n, max({1}) AS last, min({1}) AS first, CAST(coalesce(sum(CASE WHEN {1} >= TIMESTAMP '{2}' - INTERVAL 30 DAY THEN 1 ELSE 0 END), 0) AS BIGINT) AS days30, CAST(coalesce(sum(CASE WHEN {1} >= TIMESTAMP '{2}' - INTERVAL 90 DAY THEN 1 ELSE 0 END), 0) AS BIGINT) AS days90 FROM {0}"


@query(f"SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN last IS NULL THEN 'no-date' WHEN days30 > 0 THEN 'alive' WHEN days90 > 0 THEN 'fading' ELSE 'abandoned' END AS verdict FROM ({' UNION ALL '.join(_HEALTH.format(a, b, NOW) for a, b in (('events', 'ts'), ('orders', 'o_orderdate'), ('lineitem', 'l_shipdate')))})")
def data_health(s, d):
    """Activity of each table in the last 30 and 90 days, in one pass each."""
    out = None
    for name, column in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        since = lambda days: F.coalesce(F.sum(F.when(F.col(column) >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL {days} DAY"), 1).otherwise(0)), F.lit(0)).cast("long")  # noqa: E731, B023
        one = t.table(s, d, name).agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.max(column).alias("last"), F.min(column).alias("first"), since(30).alias("days30"), since(90).alias("days90"))
        out = one if out is None else out.unionByName(one)
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("last").isNull(), "no-date").when(F.col("days30") > 0, "alive").when(F.col("days90") > 0, "fading").otherwise("abandoned")
    return out.withColumn("verdict", verdict)


@query("SELECT event_type, user_id, substr(regexp_replace(props, '[0-9]+', '#', 'g'), 1, 200) AS comment, CAST(count(*) AS BIGINT) AS n, min(ts) AS first, max(ts) AS last, arg_max(props, ts) AS latest FROM events GROUP BY 1, 2, 3")
def log_summary(s, d):
    """Log entries grouped by event, user and masked comment."""
    e = t.table(s, d, "events").withColumn("comment", text.masked(F.col("props")))
    return e.groupBy("event_type", "user_id", "comment").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("props", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT event_id, ts, event_type, substr(props, 1, 5) AS comment FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 50")
def log_page(s, d):
    """A page of the log, latest first."""
    return t.table(s, d, "events").where("event_type <> 'view'").select("event_id", "ts", "event_type", F.substring("props", 1, 5).alias("comment")).orderBy(F.desc("ts"), "event_id").offset(50).limit(100)


@query("SELECT n_name AS profile, CAST(count(c_custkey) AS BIGINT) AS users, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS roles FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def profile_counts(s, d):
    """Users and roles of every profile, also of those that have none."""
    c = t.table(s, d, "customer")
    return t.table(s, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("profile")).agg(F.count("c_custkey").alias("users"), F.countDistinct("c_mktsegment").alias("roles"))


@query("""SELECT o_orderpriority AS object, o_orderstatus AS access, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS roles, bool_and(c_acctbal < 0) AS restricted FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def effective_rights(s, d):
    """Rights combined over roles: restricted only if every grant is."""
    g = t.table(s, d, "orders").join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return g.groupBy(F.col("o_orderpriority").alias("object"), F.col("o_orderstatus").alias("access")).agg(F.countDistinct("c_mktsegment").alias("roles"), F.bool_and(F.col("c_acctbal") < 0).alias("restricted"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_a' WHEN a.doc_id IS NULL THEN 'only_b' ELSE 'common' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) b ON a.doc_id = b.doc_id")
def snapshot_diff(s, d):
    """Ids in one snapshot, the other or both."""
    return rel.difference(t.table(s, d, "documents"), t.table(s, d, "labels").where("quality = 1"), "doc_id")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY source) AS total FROM c)
SELECT source, lang AS prevailing, CAST(n AS BIGINT) AS n, CAST(total - n AS BIGINT) AS outliers FROM r WHERE k = 1""")
def prevailing_values(s, d):
    """The prevailing language of every source and how many differ."""
    c = t.table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    c = c.withColumn("total", F.sum("n").over(W.partitionBy("source")))
    return graph.first_best(c, ["source"], F.desc("n"), F.col("lang")).select("source", F.col("lang").alias("prevailing"), "n", (F.col("total") - F.col("n")).alias("outliers"))


@query(f"WITH {_EDGES} SELECT src, dst, kind FROM edges WHERE layer <> 'base' EXCEPT SELECT src, dst, kind FROM edges WHERE layer = 'base'")
def added_relations(s, d):
    """Relations that only an extension layer has."""
    e = t.edges(s, d)
    keys = ["src", "dst", "kind"]
    return e.where("layer <> 'base'").select(keys).distinct().join(e.where("layer = 'base'").select(keys), keys, "left_anti")


@query(f"WITH {_EDGES} SELECT src, dst, kind, layer FROM edges WHERE (src = 'supplier:3' OR dst = 'supplier:3') AND kind IN ('supplier-nation', 'part-supplier')")
def neighbours(s, d):
    """Edges in and out of a node, of chosen kinds."""
    e = t.edges(s, d).where(F.col("kind").isin("supplier-nation", "part-supplier"))
    return e.where("src = 'supplier:3'").union(e.where("dst = 'supplier:3' AND src <> 'supplier:3'"))


@query(f"""WITH {_EDGES}, l1 AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 'region:1'), l2 AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM l1)), l3 AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM l2)),
every AS (SELECT 'region:1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) SELECT id, min(depth) AS depth FROM every GROUP BY id""")
def impact(s, d):
    """Everything that depends on a node, up to three steps."""
    back = t.edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(back, s.createDataFrame([("region:1",)], "id string"), 3)


@query(f"""WITH {_EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
l0 AS (SELECT 'nation:5' AS id, 0 AS depth, 1::BIGINT AS paths), l1 AS (SELECT dst AS id, 1 AS depth, CAST(sum(paths) AS BIGINT) AS paths FROM l0 JOIN u ON u.src = l0.id WHERE dst NOT IN (SELECT id FROM l0) GROUP BY dst),
s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1), l2 AS (SELECT dst AS id, 2 AS depth, CAST(sum(paths) AS BIGINT) AS paths FROM l1 JOIN u ON u.src = l1.id WHERE dst NOT IN (SELECT id FROM s1) GROUP BY dst),
s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2), l3 AS (SELECT dst AS id, 3 AS depth, CAST(sum(paths) AS BIGINT) AS paths FROM l2 JOIN u ON u.src = l2.id WHERE dst NOT IN (SELECT id FROM s2) GROUP BY dst)
SELECT * FROM s2 UNION ALL SELECT * FROM l3""")
def shortest_paths(s, d):
    """Distance and number of shortest paths from a node, up to three steps."""
    return graph.shortest_path_counts(t.edges(s, d), "nation:5", 3)


@query("""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, max(round(1 - l_discount, 4)) AS confidence FROM lineitem GROUP BY 1, 2 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.95 FROM supplier),
b0 AS (SELECT 'p7' AS id, 1.0::DOUBLE AS confidence), b1 AS (SELECT dst AS id, max(least(b0.confidence, e.confidence) * 0.9::DOUBLE) AS confidence FROM b0 JOIN e ON e.src = b0.id GROUP BY dst), b2 AS (SELECT dst AS id, max(least(b1.confidence, e.confidence) * 0.9::DOUBLE) AS confidence FROM b1 JOIN e ON e.src = b1.id GROUP BY dst)
SELECT id, round(max(confidence), 8) AS confidence FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY id""")
def attribution(s, d):
    """Best confidence of a chain from a part to its suppliers and nations."""
    pairs = t.table(s, d, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).agg(F.max(F.round(1 - F.col("l_discount"), 4)).alias("confidence"))
    e = pairs.union(t.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("n"), F.col("s_nationkey")), F.lit(0.95)))
    return graph.widest(e, s.createDataFrame([("p7",)], "id string"), 2).select("id", F.round("confidence", 8).alias("confidence"))


_TOKENS = "tokens AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-zäöüßéèêçñóí0-9]+')) AS word FROM documents) WHERE word <> '')"


_LETTER = "[a-zäöüßéèêçñóí0-9]"


_LETTERS = "a-zäöüßéèêçñóí0-9"
_TERM_SQL = "asked AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-zäöüßéèêçñóí0-9]+')) AS word FROM conversations WHERE conv_id = 1 AND turn = 0)"


def _counted(s, d):
    """Texts and what they hold of the words that the opening turn of a conversation asks for."""
    opening = t.table(s, d, "conversations").where("conv_id = 1 AND turn = 0")
    terms = opening.select(F.explode(F.split(F.lower("text"), f"[^{_LETTERS}]+")).alias("word")).where("word <> ''")
    per, stat = search.ranked_texts(t.table(s, d, "documents"), terms, _LETTERS)
    hits = per.select("doc_id", "n", F.inline("hits"))
    # as many rows as the query has terms, and one row
    return hits, F.broadcast(hits.groupBy("word").agg(F.count("*").alias("df"))), F.broadcast(stat)


@query(f"""WITH {_TOKENS}, {_TERM_SQL}, n AS (SELECT count(DISTINCT doc_id) AS docs FROM tokens), idf AS (SELECT word, ln(1 + (SELECT docs FROM n) / count(*)) AS idf FROM tokens WHERE word IN (SELECT word FROM asked) GROUP BY word)
SELECT doc_id, round(sum(idf), 6) AS score, CAST(count(*) AS BIGINT) AS terms FROM tokens JOIN idf USING (word) GROUP BY doc_id ORDER BY round(sum(idf), 6) DESC, doc_id LIMIT 50""")
def idf_search(s, d):
    """Documents by the weight of the terms that they hold."""
    hits, df, stat = _counted(s, d)
    weight = F.log(1 + F.col("docs") / F.col("df"))
    found = hits.join(df, "word").join(stat).groupBy("doc_id").agg(F.round(F.sum(weight), 6).alias("score"), F.count("*").alias("terms"))
    return found.orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"""WITH {_TERM_SQL}, w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-zäöüßéèêçñóí0-9]+')) AS word FROM documents), len AS (SELECT doc_id, count(*) AS n FROM w WHERE word <> '' GROUP BY 1), stat AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT doc_id, word, count(*) AS f FROM w WHERE word <> '' AND word IN (SELECT word FROM asked) GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM tf JOIN df USING (word) JOIN len USING (doc_id) CROSS JOIN stat GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 50""")
def bm25_search(s, d):
    """Documents by BM25 (k1 1.2, b 0.75)."""
    hits, df, stat = _counted(s, d)
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = weight * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    found = hits.join(df, "word").join(stat).groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(50)


@query("""WITH v AS (SELECT conv_id, turn, CAST(contains(lower(text), 'error') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS bug, CAST(contains(lower(text), 'und') AS INT) AS posting, CAST(contains(lower(text), 'que') AS INT) AS query FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN bug + posting + query = 0 THEN 'unknown' WHEN bug >= posting AND bug >= query THEN 'bug' WHEN posting >= query THEN 'posting' ELSE 'query' END AS intent, CASE WHEN bug + posting + query = 0 THEN 0.0 ELSE round(greatest(bug, posting, query)::DOUBLE / (bug + posting + query), 6) END AS confidence FROM v""")
def intent_votes(s, d):
    """The intent with most words of its lexicon; ties by priority."""
    low = F.lower("text")
    vote = lambda *words: sum(low.contains(w).cast("int") for w in words)
    v = t.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", vote("error", "the").alias("bug"), vote("und").alias("posting"), vote("que").alias("query"))
    total, best = F.col("bug") + F.col("posting") + F.col("query"), F.greatest("bug", "posting", "query")
    intent = F.when(total == 0, "unknown").when(F.col("bug") == best, "bug").when(F.col("posting") == best, "posting").otherwise("query")
    return v.select("conv_id", "turn", intent.alias("intent"), F.when(total == 0, 0.0).otherwise(F.round(best / total, 6)).alias("confidence"))


@query("SELECT p_type AS kind, p_partkey AS id, p_retailprice AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 10")
def top_per_section(s, d):
    """The ten best of each section."""
    p = t.table(s, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return rel.top_by(p, ["kind"], 10, F.desc("score"), F.col("id"))


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 20000""")
def budget_prefix(s, d):
    """Documents of every source, shortest first, until the budget would overflow."""
    docs = t.table(s, d, "documents").select("source", "doc_id", "n_chars")
    return rel.budget_prefix(docs, "source", "n_chars", "doc_id", 20000)


@query("""WITH l AS (SELECT doc_id, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, line, text, last_line AS heading FROM (SELECT *, last_value(CASE WHEN length(text) < 40 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS last_line FROM l) WHERE contains(text, 'trash')""")
def line_search(s, d):
    """Lines that hold a word, with the last short line above as their heading."""
    lines = t.table(s, d, "documents").where(F.col("text").contains("trash")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    above = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("heading", F.last(F.when(F.length("text") < 40, F.col("text")), ignorenulls=True).over(above))
    return lines.where(F.col("text").contains("trash")).select("doc_id", "line", "text", "heading")


@query("SELECT sha256(text) AS hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def blobs(s, d):
    """Texts by content hash."""
    return t.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unreferenced(s, d):
    """Documents that nothing refers to."""
    return t.table(s, d, "documents").select("doc_id").join(t.table(s, d, "labels"), "doc_id", "left_anti")


@query("""SELECT 'orphan_line' AS name, CAST(count(*) AS BIGINT) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orphan_order', CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'confidence_range', CAST(count(*) AS BIGINT) FROM lineitem WHERE NOT (1 - l_discount > 0 AND 1 - l_discount <= 1)
UNION ALL SELECT 'label_without_document', CAST(count(*) AS BIGINT) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def invariants(s, d):
    """Integrity checks; each should count nothing."""
    li, o = t.table(s, d, "lineitem"), t.table(s, d, "orders")
    checks = {
        "orphan_line": li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "orphan_order": o.join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "confidence_range": li.where("NOT (1 - l_discount > 0 AND 1 - l_discount <= 1)"),
        "label_without_document": t.table(s, d, "labels").join(t.table(s, d, "documents"), "doc_id", "left_anti"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.lit(name).alias("name"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents WHERE doc_id % 50 = 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'removed' WHEN a.h IS NULL THEN 'new' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def fingerprint_diff(s, d):
    """New, changed, removed and same documents of two generations, by content hash."""
    docs = t.table(s, d, "documents")
    new = docs.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text")).union(docs.where("doc_id % 50 = 1").select(F.col("doc_id") + 1000000, "text"))
    a, b = docs.select("doc_id", F.sha2("text", 256).alias("a")), new.select("doc_id", F.sha2("text", 256).alias("b"))
    state = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").select("doc_id", state.alias("state"))


@query("SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE n = 1")
def slice_last(s, d):
    """The last value of each user and event up to a time."""
    return rel.slice_last(t.table(s, d, "events"), ["user_id", "event_type"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "event_id").select("user_id", "event_type", "ts", "value")


_SIGN = "CASE WHEN l_returnflag IN ('N', 'A') THEN l_quantity ELSE -l_quantity END"


@query(f"""SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS month, sum(CASE WHEN l_returnflag IN ('N', 'A') THEN l_quantity ELSE 0 END) AS receipt, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS expense, sum(sum({_SIGN})) OVER (PARTITION BY l_suppkey ORDER BY date_trunc('month', l_shipdate)) AS closing FROM lineitem GROUP BY 1, 2, date_trunc('month', l_shipdate)""")
def balance_and_turnovers(s, d):
    """Monthly receipts, expenses and closing balance of each supplier."""
    li = t.table(s, d, "lineitem")
    into = F.sum(F.when(F.col("l_returnflag").isin("N", "A"), F.col("l_quantity")).otherwise(0.0))
    out = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    m = li.groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(into.alias("receipt"), out.alias("expense"))
    return m.withColumn("closing", F.sum(F.col("receipt") - F.col("expense")).over(W.partitionBy("l_suppkey").orderBy("month")))


@query(f"SELECT l_partkey, l_suppkey, sum({_SIGN}) AS balance FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2 HAVING sum({_SIGN}) <> 0")
def balances(s, d):
    """Balance of each part and supplier before a time; zero balances are left out."""
    signed = F.when(F.col("l_returnflag").isin("N", "A"), F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return t.table(s, d, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'").groupBy("l_partkey", "l_suppkey").agg(F.sum(signed).alias("balance")).where("balance <> 0")


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def totals(s, d):
    """Totals by status and priority with subtotals."""
    return t.table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def json_properties(s, d):
    """Events by a property of their JSON."""
    return t.table(s, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT host, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT first) AS BIGINT) AS langs FROM (SELECT lower(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[:/?#].*$', '')) AS host, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')[1] AS first FROM pages) GROUP BY 1""")
def url_hosts(s, d):
    """Pages and first path segments by host."""
    p = t.table(s, d, "pages").select(text.host(F.col("url")).alias("host"), text.segments(F.col("url"))[0].alias("first"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("first").alias("langs"))


@query("""SELECT c_custkey AS user_id, CASE WHEN n_nationkey IS NULL THEN 'no_profile' WHEN r_name NOT IN ('ASIA', 'REGION_1', 'EUROPE') AND n_regionkey > 2 THEN 'no_group' WHEN c_acctbal < 0 THEN 'restricted' WHEN orders = 0 THEN 'no_objects' ELSE 'granted' END AS step
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey""".replace("orders = 0", "orders IS NULL"))
def access_diagnosis(s, d):
    """The first step of the chain at which a user's access fails."""
    o = t.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    chain = t.table(s, d, "customer").join(t.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    step = F.when(F.col("n_nationkey").isNull(), "no_profile").when(~F.col("r_name").isin("ASIA", "REGION_1", "EUROPE") & (F.col("n_regionkey") > 2), "no_group").when(F.col("c_acctbal") < 0, "restricted").when(F.col("orders").isNull(), "no_objects").otherwise("granted")
    return chain.select(F.col("c_custkey").alias("user_id"), step.alias("step"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || source), 1, 32) AS uid FROM documents")
def symbol_uids(s, d):
    """Stable ids from the parts of a key."""
    return t.table(s, d, "documents").select("doc_id", text.uid(F.col("doc_id").cast("string"), F.col("source")).alias("uid"))
