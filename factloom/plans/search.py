"""Registered queries: search, intents, anchors, scores and packing, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..sources import facts
from ..sources import tables as t
from ..sources.shared import kept
from .lookups import fact_query
from .queries import query

FIELDS = ["name", "module", "summary", "doc"]


def _asked(s, d):
    """A query for each name of a part: its words run together, in the plural."""
    names = t.table(s, d, "part").groupBy(F.col("p_name").alias("query")).agg(F.lit(1))
    return names.select("query", F.concat(F.replace(F.initcap("query"), F.lit(" "), F.lit("")), F.lit("s thing red reds")).alias("text"))


def _methods(s, d):
    """Methods with their texts: parts, their kind and brand, and the document of the same number."""
    docs = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("doc"))
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("module"), F.col("p_brand").alias("summary"))
    return p.join(docs, "id", "left")


_WORDS = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"""
# the tables' texts have no endings but the Latin plurals
_KEY = "CASE WHEN regexp_matches({0}, '^.{{2,}}[sxzh]es$') THEN left({0}, length({0}) - 2) WHEN regexp_matches({0}, '^.{{3,}}s$') THEN left({0}, length({0}) - 1) ELSE {0} END"
_STOP = "'или', 'для', 'при', 'что', 'это', 'как', 'его', 'под', 'над', 'без', 'если', 'либо', 'чтобы', 'также'"


def _terms(asked: str) -> str:
    """Terms of the texts of ``asked`` (query, text) in SQL."""
    return f"""asked AS ({asked}), said AS (SELECT query, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT query, list_transform({_WORDS.format('text')}, lambda w: replace(lower(w), 'ё', 'е')) AS w FROM asked)),
keyed AS (SELECT query, pos, word, {_KEY.format('word')} AS key FROM said WHERE length(word) > 2 AND word NOT IN ({_STOP})),
terms AS (SELECT query, word AS term, key, CAST(n - 1 AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY pos) AS k FROM keyed) WHERE k = 1) WHERE n <= 32)"""


_TERMS = _terms("SELECT p_name AS query, (SELECT string_agg(upper(left(x, 1)) || substr(x, 2), '') FROM (SELECT unnest(string_split(p_name, ' ')) AS x)) || 's thing red reds' AS text FROM (SELECT DISTINCT p_name FROM part)")
_FOUND = f"""{_TERMS}, methods AS (SELECT p_partkey AS id, p_name AS name, p_type AS module, p_brand AS summary, text AS doc FROM part LEFT JOIN documents ON doc_id = p_partkey),
words AS ({' UNION '.join(f"SELECT id, '{f}' AS field, unnest(list_transform({_WORDS.format(f'coalesce({f}, chr(32))')}, lambda w: replace(lower(w), 'ё', 'е'))) AS word FROM methods" for f in FIELDS)}),
hit AS (SELECT DISTINCT query, term, id, field FROM terms t JOIN (SELECT id, field, {_KEY.format('word')} AS key FROM words) w ON w.key = t.key),
df AS (SELECT query, term, ln(1 + (SELECT count(*) FROM methods) / count(DISTINCT id)::DOUBLE) AS anywhere, CASE WHEN count(DISTINCT CASE WHEN field <> 'doc' THEN id END) > 0 THEN ln(1 + (SELECT count(*) FROM methods) / count(DISTINCT CASE WHEN field <> 'doc' THEN id END)::DOUBLE) ELSE 0.0 END AS firm FROM hit GROUP BY 1, 2),
each AS (SELECT h.query, h.term, id, max(CASE field WHEN 'name' THEN 1.0 WHEN 'module' THEN 0.7 WHEN 'summary' THEN 0.8 ELSE 0.5 END * CASE WHEN field = 'doc' THEN anywhere ELSE firm END) AS best, sum(CASE field WHEN 'name' THEN 3.0 WHEN 'module' THEN 2.0 WHEN 'summary' THEN 1.0 ELSE 0.5 END) AS place, bool_or(field = 'name') AS named, bool_or(field <> 'doc') AS strong FROM hit h JOIN df ON df.query = h.query AND df.term = h.term GROUP BY 1, 2, 3),
found AS (SELECT e.query, e.id, CAST(count(*) AS BIGINT) AS matched, CAST(count(*) FILTER (strong) AS BIGINT) AS strong, round(sum(best), 6) AS coverage, round(least(1.0, count(*) FILTER (named) / (SELECT count(*) FROM words w WHERE w.id = e.id AND field = 'name')::DOUBLE), 9) AS name_fit, CAST(sum(place) AS DOUBLE) AS score FROM each e GROUP BY 1, 2)"""


def _found(s, d):
    m = _methods(s, d)
    terms = kept(search.query_terms(_asked(s, d)))
    return search.fielded_search(m, FIELDS, terms, m.count(), terms.count()), m


@query(f"WITH {_terms('SELECT conv_id * 1000 + turn AS query, text FROM conversations')} SELECT query, term, key, n FROM terms")
def query_terms(s, d):
    """Terms of every turn of a conversation: no short or empty words, forms of one word once."""
    return search.query_terms(t.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), "text"))


@query(f"WITH {_FOUND} SELECT * FROM found")
def fielded_search(s, d):
    """Methods that hold words of a query, by coverage, fit of the name and place."""
    return _found(s, d)[0]


@query(f"""WITH {_FOUND}, cut AS (SELECT query, CASE WHEN module IN ('ECONOMY', 'STANDARD') THEN 'library' ELSE 'other' END AS section, f.id, summary < 'Brand#2' AS deprecated, row_number() OVER (PARTITION BY query, module IN ('ECONOMY', 'STANDARD') ORDER BY coverage DESC, name_fit DESC, score DESC, name, f.id) AS k FROM found f JOIN methods m ON m.id = f.id)
SELECT query, section, id, CASE WHEN k <= 5 THEN 'full' ELSE 'brief' END AS shape, CAST(row_number() OVER (PARTITION BY query, section, k <= 5 ORDER BY deprecated, k) AS INTEGER) AS n FROM cut WHERE k <= 15""")
def find_api(s, d):
    """Methods for a query in two sections, some in full and some by name; deprecated ones last."""
    found, m = _found(s, d)
    section = F.when(F.col("module").isin("ECONOMY", "STANDARD"), "library").otherwise("other")
    named = m.select("id", "name", section.alias("section"), (F.col("summary") < "Brand#2").alias("deprecated"))
    return search.sections(found.join(named, "id"), 5, 10)


@query(f"WITH {_FOUND} SELECT query, f.id, name FROM found f JOIN methods m ON m.id = f.id WHERE strong >= 2 AND name_fit = 1")
def ready_methods(s, d):
    """Methods that already do what a task asks: two strong words or more and the whole name."""
    found, m = _found(s, d)
    return found.where("strong >= 2 AND name_fit = 1").join(m.select("id", "name"), "id").select("query", "id", "name")


@fact_query("SELECT symbol, s.name, m.name AS module, s.kind, component FROM symbols s JOIN modules m ON m.module = s.module WHERE exported AND m.kind <> 'form'")
def api_catalogue(s, d):
    """All public methods with their modules and types."""
    m = facts.modules(s, d).where("kind <> 'form'").select("module", F.col("name").alias("m"))
    return facts.symbols(s, d).where("exported").join(m, "module").select("symbol", "name", F.col("m").alias("module"), "kind", "component")


# Invented stems of the corpus' languages, in order of preference.
_LEXICON = {"posting": ["thing", "tion", "ung"], "form": ["hea", "ein"], "query": ["rend", "lager", "que"], "rights": ["en", "ou"]}
_VOTES = {k: " + ".join(f"CAST(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){w}') AS INTEGER)" for w in v) for k, v in _LEXICON.items()}


@query(f"""WITH v AS (SELECT conv_id * 1000 + turn AS id, {', '.join(f'{e} AS {k}' for k, e in _VOTES.items())} FROM conversations), m AS (SELECT *, greatest(posting, form, query, rights) AS best, posting + form + query + rights AS total FROM v)
SELECT id, CASE WHEN total = 0 THEN 'unknown' WHEN posting = best THEN 'posting' WHEN form = best THEN 'form' WHEN query = best THEN 'query' ELSE 'rights' END AS intent, CASE WHEN total = 0 THEN 0.0 ELSE round(best / total::DOUBLE, 9) END AS confidence FROM m""")
def intent_classes(s, d):
    """The intent of every turn of a conversation, by stems at word beginnings."""
    return search.intents(t.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), _LEXICON)


@query("""WITH tasks AS (SELECT s_suppkey AS task, CASE s_suppkey % 5 WHEN 0 THEN 'nation_' || s_nationkey WHEN 1 THEN 'red rod' WHEN 2 THEN 'cold anvli' WHEN 3 THEN 'small nothing at all' ELSE 'hot plate' END AS name FROM supplier), objects AS (SELECT DISTINCT lower(n_name) AS name FROM nation), symbols AS (SELECT DISTINCT lower(p_name) AS name FROM part),
exact AS (SELECT task, 'object' AS kind, o.name, 1.0::DOUBLE AS strength FROM tasks JOIN objects o USING (name) UNION ALL SELECT task, 'symbol', o.name, 0.95 FROM tasks JOIN symbols o USING (name)), rest AS (SELECT * FROM tasks WHERE task NOT IN (SELECT task FROM exact)),
fuzzy AS (SELECT task, 'fuzzy' AS kind, o.name, 0.6::DOUBLE AS strength FROM rest r JOIN symbols o ON levenshtein(r.name, o.name) <= 2),
full_text AS (SELECT task, 'text' AS kind, o.name, 0.4::DOUBLE AS strength FROM rest r JOIN symbols o ON split_part(r.name, ' ', 1) = split_part(o.name, ' ', 1) WHERE task NOT IN (SELECT task FROM fuzzy)),
every AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy UNION ALL SELECT * FROM full_text)
SELECT task, kind, name, strength, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY strength DESC, kind, name) AS n FROM every) WHERE n <= 6""")
def anchors(s, d):
    """What tasks name: objects, symbols, else near names, else names with the same first word."""
    key = F.col("s_suppkey") % 5
    name = F.when(key == 0, F.concat(F.lit("nation_"), "s_nationkey")).when(key == 1, "red rod").when(key == 2, "cold anvli").when(key == 3, "small nothing at all").otherwise("hot plate")
    tasks = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("task"), name.alias("name"))
    objects = t.table(s, d, "nation").select(F.lower("n_name").alias("name"))
    return search.anchors(tasks, objects, t.table(s, d, "part").select(F.lower("p_name").alias("name")))


_CASES = {"A": "definition", "N": "callers", "R": "scheduled_job"}


@query("""WITH c AS (SELECT l_suppkey AS task, l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.85 ELSE 0.4 END AS weight, l_linenumber AS depth, 1 - l_discount AS confidence, l_quantity AS cost, CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 0.65 END AS component FROM lineitem)
SELECT task, id, round(weight * 0.95 * 0.6 ^ (depth - 1) * confidence * component / greatest(cost, 1), 9) AS score FROM c""")
def candidate_scores(s, d):
    """Candidates of a context by kind, distance, certainty, component and cost."""
    li = t.table(s, d, "lineitem")
    score = search.candidate_score(text.lookup(F.col("l_returnflag"), _CASES), F.lit(0.95), F.lit(1.0), F.col("l_linenumber") - 1, 1 - F.col("l_discount"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.65), F.col("l_quantity"))
    return li.select(F.col("l_suppkey").alias("task"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(score, 9).alias("score"))


_PACK = """WITH RECURSIVE c AS (SELECT source AS task, lang AS category, doc_id AS id, n_chars AS cost, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 WHEN 'xx' THEN 2 WHEN 'yy' THEN 3 ELSE 4 END, 1000.0 / n_chars DESC, doc_id) AS k FROM documents),
w(task, k, category, id, used, admitted) AS (SELECT DISTINCT source, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, false FROM documents UNION ALL SELECT c.task, c.k, c.category, c.id, CASE WHEN used + cost <= 60000 THEN used + cost ELSE used END, used + cost <= 60000 FROM w JOIN c ON c.task = w.task AND c.k = w.k + 1),
packed AS (SELECT task, category, id, used, admitted FROM w WHERE k > 0)"""
_REQUIRED = ["de", "fr", "xx", "yy"]


def _packed(s, d):
    docs = t.table(s, d, "documents")
    return search.packed_context(docs.select(F.col("source").alias("task"), F.col("lang").alias("category"), F.col("doc_id").alias("id"), F.col("n_chars").alias("cost"), (1000.0 / F.col("n_chars")).alias("score")), _REQUIRED, 60000), docs


@query(f"{_PACK} SELECT * FROM packed")
def packed_context(s, d):
    """Candidates that a budget admits, required kinds first."""
    return _packed(s, d)[0]


@query(f"""{_PACK}, wanted AS (SELECT DISTINCT source AS task, unnest(['de', 'fr', 'xx', 'yy']) AS category FROM documents), n AS (SELECT task, category, count(*) AS total, count(*) FILTER (admitted) AS returned FROM packed GROUP BY 1, 2)
SELECT w.task, w.category, CAST(coalesce(returned, 0) AS BIGINT) AS returned, CAST(coalesce(total, 0) AS BIGINT) AS total, CASE WHEN total IS NULL AND w.category = 'xx' THEN 'complete_empty' WHEN coalesce(returned, 0) = 0 THEN 'missing' WHEN returned < total THEN 'partial' ELSE 'complete_inline' END AS status FROM wanted w LEFT JOIN n ON n.task = w.task AND n.category = w.category""")
def pack_coverage(s, d):
    """How far the required kinds are covered by what was admitted."""
    found, docs = _packed(s, d)
    return search.coverage(found, docs.select(F.col("source").alias("task")), _REQUIRED, ["xx"])


@query("""SELECT p_partkey AS id, p_name AS name, CASE WHEN contains(p_name, 'gear') THEN 3 WHEN contains(lower(p_type), 'gear') THEN 2 WHEN contains(lower(text), 'gear') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'prom') THEN 3 WHEN contains(lower(p_type), 'prom') THEN 2 WHEN contains(lower(text), 'prom') THEN 1 ELSE 0 END AS score
FROM part LEFT JOIN documents ON doc_id = p_partkey WHERE contains(p_name, 'gear') OR contains(lower(p_type), 'gear') OR contains(lower(text), 'gear') OR contains(p_name, 'prom') OR contains(lower(p_type), 'prom') OR contains(lower(text), 'prom')""")
def extension_points(s, d):
    """Methods that may be overridden for a task, by where its stems stand."""
    return search.extension_points(_methods(s, d), ["gear", "prom"]).select("id", "name", "score")
