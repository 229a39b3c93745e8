"""Registered queries: facts of source texts that are made from the tables and read back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code
from ..sources import files
from ..sources import tables as t
from ..sources.shared import parted
from .queries import query

#: Lines of orders that one task makes source texts of and reads.
LINES = 250_000

_CODE = {
    "AF": 'Т = "ВЫБРАТЬ * ИЗ Док";', "AO": "Выборка = Запрос.Выполнить(); // Лишнее(1)", "NF": "О = РегистрыНакопления.Запас.Остатки(Дата);",
    "NO": 'Т = "ВЫБРАТЬ " + Поля;', "RF": "Н = РегистрыНакопления.Запас.СоздатьНаборЗаписей();", "RO": "Н.Записать();",
}
_LINES = "l AS (SELECT l_orderkey AS module, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line, code FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS code FROM lineitem GROUP BY 1, 2))"


def _found(s, d):
    """Lines of one module for each order: a heading, a line for each of its lines, the end."""
    # few bytes of lines are much work, so they are parted by their number, and once for all that follows
    rows = t.table(s, d, "lineitem")
    few = parted(rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "l_orderkey", rows.count(), LINES)
    li = few.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("k"))
    own = F.element_at(F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair]), F.col("k"))
    body = li.groupBy(F.col("l_orderkey").alias("module")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", own.alias("code")))), lambda x: x["code"]).alias("c"))
    head = F.concat(F.lit("Процедура П"), "module", F.lit("(А, Знач Б = 1) Экспорт"))
    return code.lines(body.select("module", F.array_join(F.concat(F.array(head), "c", F.array(F.lit("КонецПроцедуры"), F.lit("А = 1;"))), "\n").alias("text")))


@query(f"WITH {_LINES} SELECT DISTINCT module, 'П' || module AS routine, 1 AS line, false AS function, 2 AS params, true AS exported FROM l")
def code_routines(s, d):
    """Routines of source texts."""
    return code.routines(_found(s, d))


@query(f"""WITH {_LINES} SELECT module, 'П' || module AS routine, CAST(line AS INTEGER) AS line, CASE code WHEN 'AO' THEN 'Запрос.Выполнить' WHEN 'NF' THEN 'Запас.Остатки' WHEN 'RF' THEN 'Запас.СоздатьНаборЗаписей' ELSE 'Н.Записать' END AS name FROM l WHERE code IN ('AO', 'NF', 'RF', 'RO')""")
def code_references(s, d):
    """Names that source texts call, with the routine that calls them."""
    return code.references(code.placed(_found(s, d)))


@query(f"WITH {_LINES} SELECT module, CAST(line AS INTEGER) AS line, CASE code WHEN 'AF' THEN 'static' ELSE 'partial' END AS kind, CASE code WHEN 'AF' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM l WHERE code IN ('AF', 'NO')")
def code_queries(s, d):
    """Query literals of source texts."""
    return code.query_literals(_found(s, d))


@query(f"""WITH {_LINES}, w AS (SELECT *, max(CASE WHEN code = 'RF' THEN 1 END) OVER (PARTITION BY module ORDER BY line) AS bound FROM l)
SELECT module, CAST(line AS INTEGER) AS line, 'Запас' AS register, CASE code WHEN 'NF' THEN 'read' ELSE 'write' END AS mode, CASE code WHEN 'NF' THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM w WHERE code = 'NF' OR code = 'RO' AND bound = 1""")
def code_accesses(s, d):
    """Register accesses of source texts, also through bound variables."""
    return code.register_accesses(code.placed(_found(s, d)))


@query(f"WITH {_LINES}, n AS (SELECT module, max(line) AS last FROM l GROUP BY 1) SELECT module, CAST(line AS INTEGER) AS line, 'П' || module AS routine FROM (SELECT module, unnest(range(1, last + 2)) AS line FROM n) UNION ALL SELECT module, CAST(last + 2 AS INTEGER), NULL FROM n")
def enclosing_routines(s, d):
    """The routine that each line stands in; after its end there is none."""
    return code.placed(_found(s, d)).select("module", "line", "routine")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS own FROM documents WHERE lang IN ('en', 'fr'))
SELECT doc_id, CAST(line AS INTEGER) AS line, count(*) OVER () AS total FROM l WHERE regexp_matches(own, '(?i)th(e|at)\\s+[a-z]+ti') ORDER BY doc_id, line LIMIT 200""")
def regex_search(s, d):
    """Lines that a pattern matches in any case within a scope: the first ones and how many there are."""
    docs = t.table(s, d, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "own"))
    hit = docs.where(F.col("own").rlike(r"(?i)th(e|at)\s+[a-z]+ti")).select("doc_id", (F.col("line") + 1).alias("line"))
    return hit.orderBy("doc_id", "line").limit(200).join(F.broadcast(hit.agg(F.count("*").alias("total"))))  # one row


_PATHS = """p AS (SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'Catalogs/' || p_name || '/Ext/ObjectModule.bsl' WHEN 'MEDIUM' THEN 'CommonModules/' || p_name || '/Ext/Module.bsl' WHEN 'STANDARD' THEN 'Catalogs/' || p_name || '/Forms/Item/Ext/Form.xml' WHEN 'LARGE' THEN 'Roles/' || p_name || '/Ext/Rights.xml' WHEN 'PROMO' THEN 'Documents/' || p_name || '.xml' ELSE '.git/' || p_name END AS path FROM part)"""


def _paths(s, d):
    name, kind = F.col("p_name"), F.col("p_type")
    path = F.when(kind == "ECONOMY", F.concat(F.lit("Catalogs/"), name, F.lit("/Ext/ObjectModule.bsl"))).when(kind == "MEDIUM", F.concat(F.lit("CommonModules/"), name, F.lit("/Ext/Module.bsl"))).when(kind == "STANDARD", F.concat(F.lit("Catalogs/"), name, F.lit("/Forms/Item/Ext/Form.xml")))
    path = path.when(kind == "LARGE", F.concat(F.lit("Roles/"), name, F.lit("/Ext/Rights.xml"))).when(kind == "PROMO", F.concat(F.lit("Documents/"), name, F.lit(".xml"))).otherwise(F.concat(F.lit(".git/"), name))
    return t.table(s, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))


@query(f"WITH {_PATHS} SELECT id, CASE WHEN path LIKE '%/Ext/ObjectModule.bsl' THEN 'object module' WHEN path LIKE 'CommonModules/%' THEN 'common module' WHEN path LIKE '%/Form.xml' THEN 'form' WHEN path LIKE '%/Rights.xml' THEN 'rights' WHEN path LIKE '%.xml' THEN 'object' ELSE 'other' END AS kind FROM p")
def file_kinds(s, d):
    """Kinds of files by their paths."""
    return _paths(s, d).select("id", files.kind(F.col("path")).alias("kind"))


@query(f"WITH {_PATHS} SELECT id, path FROM p WHERE (regexp_matches(path, '^Catalogs/(.*/)?[^/]*[.]bsl$') OR regexp_matches(path, '^Documents/[^/]*d[.]xml$')) AND NOT starts_with(path, '.git/')")
def glob_paths(s, d):
    """Paths that include patterns match and neither exclude patterns nor ignored folders."""
    return files.chosen(_paths(s, d), ["Catalogs/**/*.bsl", "Documents/*?d.xml", ".git/**"], ["**/Forms/**"]).select("id", "path")


@query(f"WITH {_PATHS} SELECT split_part(path, '/', 1) AS folder, CAST(count(*) AS BIGINT) AS files FROM p WHERE NOT starts_with(path, '.git/') GROUP BY 1 HAVING bool_or(path LIKE '%.bsl')")
def project_folders(s, d):
    """Folders that may be components: those with code, a few levels below the root."""
    return files.projects(_paths(s, d), 1)


@query()
def tree_scan(s, d):
    """Files of the tables' folder with size and time; their content is not read."""
    return files.tree(s, d, ["**/*.parquet", "*.parquet"], []).select("path", "length")


@query("SELECT p_partkey AS id, p_type IN ('ECONOMY', 'SMALL') AS reads FROM part")
def select_guard(s, d):
    """Whether texts are queries that only read."""
    texts = {"ECONOMY": "// x\n ВЫБРАТЬ 1", "SMALL": "select\n1", "MEDIUM": "SELECTED", "PROMO": "УДАЛИТЬ 1", "LARGE": '"SELECT 1"'}
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col("p_type")), F.lit(""))
    return t.table(s, d, "part").select(F.col("p_partkey").alias("id"), code.is_query(own).alias("reads"))
