"""Registered queries: comments of routines and drafts against ready methods, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafts
from ..sources import tables as t
from .queries import query
from .search import _KEY, _STOP, _WORDS

# A draft of two routines stands for each nation; methods are the parts, in modules by size.
_D = "d AS (SELECT n_nationkey AS k, n_name, x.p_name AS a, y.p_name AS b FROM nation JOIN part x ON x.p_partkey = n_nationkey * 7 JOIN part y ON y.p_partkey = n_nationkey * 3 + 1)"


def _code(s, d):
    """The drafts' texts."""
    p = t.table(s, d, "part")
    n = t.table(s, d, "nation")
    x, y = p.select(F.col("p_partkey").alias("xk"), F.col("p_name").alias("a")), p.select(F.col("p_partkey").alias("yk"), F.col("p_name").alias("b"))
    both = n.join(x, F.col("xk") == F.col("n_nationkey") * 7).join(y, F.col("yk") == F.col("n_nationkey") * 3 + 1)
    camel = lambda c: F.replace(F.initcap(c), F.lit(" "), F.lit(""))
    text = F.concat(
        F.lit("А = 1; // не о том\n\n//\n// Finds "), "b", F.lit("s of "), "n_name", F.lit("\n//  second line\n&НаСервере\nАсинх Функция "), camel("a"), F.lit("s(А)\n\t// внутри\n\tВозврат 1;\nКонецФункции\n// Far away\n\nПроцедура ПриЗаписи"), camel("a"),
        F.lit("()\nКонецПроцедуры\n/// "), "a", F.lit("\nПроцедура "), camel("b"), F.lit("()\nКонецПроцедуры"),
    )
    return both.select(F.col("n_nationkey").alias("module"), text.alias("text"))


_CAMEL = "(SELECT string_agg(upper(left(x, 1)) || substr(x, 2), '') FROM (SELECT unnest(string_split({0}, ' ')) AS x))"
_ROUTINES = f"""{_D}, r AS (SELECT k AS module, 1::BIGINT AS number, {_CAMEL.format('a')} || 's' AS routine, 7::BIGINT AS line, chr(10) || 'Finds ' || b || 's of ' || n_name || chr(10) || 'second line' AS doc, 'Finds ' || b || 's of ' || n_name AS summary FROM d
UNION ALL SELECT k, 2, 'ПриЗаписи' || {_CAMEL.format('a')}, 13, '', '' FROM d UNION ALL SELECT k, 3, {_CAMEL.format('b')}, 16, a, a FROM d)"""


@query(f"WITH {_ROUTINES} SELECT * FROM r")
def routine_comments(s, d):
    """Routines with the comment above their heading and its first line."""
    return drafts.documented(_code(s, d))


def _terms(name: str, of: str) -> str:
    """Keys of the terms of ``text`` in ``of`` (draft, text)."""
    return f"""{name}_w AS (SELECT draft, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT draft, list_transform({_WORDS.format('text')}, lambda w: replace(lower(w), 'ё', 'е')) AS w FROM ({of}))), {name} AS (SELECT DISTINCT draft, {_KEY.format('word')} AS key FROM {name}_w WHERE length(word) > 2 AND word NOT IN ({_STOP}))"""


@query(f"""WITH {_ROUTINES}, drafts AS (SELECT module * 10 + number AS draft, routine AS name, doc, 'm' || module AS own FROM r WHERE number <> 2), {_terms('named', 'SELECT draft, name AS text FROM drafts')}, {_terms('every', "SELECT draft, name || ' ' || doc AS text FROM drafts")},
sizes AS (SELECT draft, count(*) AS terms, (SELECT count(*) FROM named n WHERE n.draft = e.draft) AS name_terms FROM every e GROUP BY 1),
methods AS (SELECT p_partkey AS id, 'm' || p_size AS owner, p_type IN ('ECONOMY', 'STANDARD') AS library, p_name AS name, p_type || ' ' || p_brand AS summary FROM part WHERE p_brand >= 'Brand#12'),
words AS (SELECT id, field, unnest(list_transform({_WORDS.format("CASE field WHEN 'name' THEN name ELSE owner || ' ' || summary END")}, lambda w: lower(w))) AS word FROM methods, (VALUES ('name'), ('rest')) f(field)),
held AS (SELECT id, {_KEY.format('word')} AS key, bool_or(field = 'name') AS in_name FROM words GROUP BY 1, 2), size AS (SELECT id, count(*) AS name_words FROM held WHERE in_name GROUP BY 1),
worth AS (SELECT key, ln(1 + (SELECT count(*) FROM part) / count(*)::DOUBLE) AS w FROM held GROUP BY 1),
found AS (SELECT e.draft, h.id, count(*) AS matched, count(*) FILTER (in_name) AS names, count(*) FILTER (in_name AND EXISTS (SELECT 1 FROM named n WHERE n.draft = e.draft AND n.key = e.key)) AS mutual, round(sum(w * CASE WHEN in_name THEN 1.0 ELSE 0.7 END::DOUBLE), 6) AS score FROM every e JOIN held h ON h.key = e.key JOIN worth o ON o.key = e.key GROUP BY 1, 2),
good AS (SELECT f.*, m.library FROM found f JOIN sizes z ON z.draft = f.draft AND terms >= 2 AND name_terms > 0 JOIN drafts d ON d.draft = f.draft JOIN methods m ON m.id = f.id AND m.owner <> d.own LEFT JOIN size s ON s.id = f.id WHERE CASE WHEN library THEN matched >= 2 ELSE names >= 2 AND names * 3 >= name_words * 2 AND mutual * 2 >= name_terms END)
SELECT draft, CASE WHEN library THEN 'library' ELSE 'other' END AS section, id, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY draft, library ORDER BY score DESC, names DESC, id) AS n FROM good) WHERE n <= 3""")
def draft_check(s, d):
    """The methods that do already what the routines of drafts are about to do."""
    found = drafts.documented(_code(s, d))
    own = found.where(~drafts.is_handler(F.col("routine"))).select((F.col("module") * 10 + F.col("number")).alias("draft"), F.col("routine").alias("name"), "doc", F.concat(F.lit("m"), "module").alias("owner"))
    p = t.table(s, d, "part")
    methods = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("m"), "p_size").alias("owner"), F.col("p_type").isin("ECONOMY", "STANDARD").alias("library"), (F.col("p_brand") < "Brand#12").alias("deprecated"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("summary"))
    return drafts.ready_made(own, methods, p.count())
