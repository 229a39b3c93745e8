"""Facts of source texts: lines, routines, references, query literals and register accesses.

A text is read line by line with column functions; what depends on earlier lines (the routine
that a line stands in, what a variable was bound to) is a window over the lines of a module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

NAME = r"[\p{L}_][\p{L}\p{N}_]*"
# Words of the language in its two spellings.
HEADING = rf"(?iuU)^\s*(процедура|функция|procedure|function)\s+({NAME})\s*\(([^)]*)\)\s*(экспорт|export)?"
END = r"(?iuU)^\s*(конецпроцедуры|конецфункции|endprocedure|endfunction)\b"
REGION, END_REGION = rf"(?iuU)^\s*#(?:область|region)\s+({NAME})", r"(?iuU)^\s*#(?:конецобласти|endregion)\b"
QUERY = r'(?iu)"\s*(?:выбрать|select)\s[^"]*"?'
REGISTERS = r"(?:РегистрыНакопления|РегистрыСведений|AccumulationRegisters|InformationRegisters)"
READS = r"(?:Остатки|Обороты|СрезПоследних|СрезПервых|Выбрать|Получить|Balance|Turnovers|SliceLast|SliceFirst|Select|Get)"
CREATES, WRITES, CLEARS, LOADS = r"(?:СоздатьНаборЗаписей|CreateRecordSet)", r"(?:Записать|Write)", r"(?:Очистить|Clear)", r"(?:Прочитать|Read)"
#: How sure each kind of finding is.
SURE = {"static": 0.9, "partial": 0.6, "direct": 0.95, "bound": 0.85}


def lines(sources: DataFrame) -> DataFrame:
    """``module, line, code`` of ``sources`` (module, text): lines from 1, without comments."""
    each = sources.select("module", F.posexplode(F.split("text", "\n", -1)).alias("line", "code"))
    return each.select("module", (F.col("line") + 1).alias("line"), text.without_comments(F.col("code")).alias("code"))


def placed(found: DataFrame) -> DataFrame:
    """Lines with the ``routine`` that they stand in (null outside) and the path of their ``region``."""
    so_far = W.partitionBy("module").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    code = F.col("code")
    after_end = F.lag("_end", 1, False).over(W.partitionBy("module").orderBy("line"))
    step = F.when(code.rlike(REGION), F.struct(F.lit(True).alias("opens"), F.regexp_extract(code, REGION, 1).alias("name"))).when(code.rlike(END_REGION), F.struct(F.lit(False).alias("opens"), F.lit("").alias("name")))
    path = F.aggregate(F.collect_list(step).over(so_far), F.array().cast("array<string>"), lambda s, x: F.when(x["opens"], F.array_append(s, x["name"])).otherwise(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))))
    # each pattern looks at a line once
    flagged = found.select("module", "line", "code", F.nullif(F.regexp_extract(code, HEADING, 2), F.lit("")).alias("_head"), code.rlike(END).alias("_end"))
    marked = flagged.withColumn("_mark", F.when(F.col("_end"), None).when(after_end & F.col("_head").isNull(), "").otherwise(F.col("_head")))
    return marked.select("module", "line", "code", F.nullif(F.last("_mark", ignorenulls=True).over(so_far), F.lit("")).alias("routine"), F.array_join(path, "/").alias("region"))


def routines(found: DataFrame) -> DataFrame:
    """``module, routine, line, function, params, exported`` of every heading."""
    code = F.col("code")
    part = lambda k: F.regexp_extract(code, HEADING, k)
    return found.where(code.rlike(HEADING)).select("module", part(2).alias("routine"), "line", F.lower(part(1)).isin("функция", "function").alias("function"), F.size(text.top_arguments(part(3))).alias("params"), (part(4) != "").alias("exported"))


def references(found: DataFrame) -> DataFrame:
    """``module, routine, line, name``: called names, with the name before the dot if there is one."""
    bare = F.regexp_replace("code", r'"[^"]*"?', '""')
    names = F.regexp_extract_all(bare, F.lit(rf"((?:{NAME}\.)?{NAME})\s*\("), F.lit(1))
    return found.where(~F.col("code").rlike(HEADING)).select("module", "routine", "line", F.explode(names).alias("name"))


def query_literals(found: DataFrame) -> DataFrame:
    """``module, line, kind, confidence``: literals that hold a query; beside a ``+`` they are partial."""
    kind = F.when(F.col("code").rlike(QUERY + r"\s*\+"), "partial").otherwise("static")
    return found.where(F.col("code").rlike(QUERY)).select("module", "line", kind.alias("kind"), text.lookup(kind, SURE).alias("confidence"))


def register_accesses(found: DataFrame) -> DataFrame:
    """``module, line, register, mode, confidence``: reads through a register's manager, and what a
    variable does that the routine last bound to a record set."""
    code = F.col("code")
    direct = rf"{REGISTERS}\.({NAME})\.{READS}\("
    bind = rf"^\s*({NAME})\s*=\s*{REGISTERS}\.({NAME})\.{CREATES}\("
    use = rf"^\s*({NAME})\.({WRITES}|{CLEARS}|{LOADS})\("
    part = lambda pattern, k: F.nullif(F.regexp_extract(code, pattern, k), F.lit(""))
    so_far = W.partitionBy("module", "routine", "name").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    # reads and uses are rows of one table, so lines are cut, placed and looked at once
    touched = found.select("module", "routine", "line", "code", part(direct, 1).alias("read"), F.coalesce(part(bind, 1), part(use, 1)).alias("name")).where("read IS NOT NULL OR name IS NOT NULL")
    bound = touched.select("module", "line", "read", part(use, 2).alias("method"), F.last(part(bind, 2), ignorenulls=True).over(so_far).alias("register"))
    method = F.col("method")
    mode = F.when(method.rlike(f"^{WRITES}$"), "write").when(method.rlike(f"^{CLEARS}$"), "clear").otherwise("read")
    access = lambda register, how, sure: F.struct(register.alias("register"), how.alias("mode"), F.lit(SURE[sure]).alias("confidence"))
    own = F.array(F.when(F.col("read").isNotNull(), access(F.col("read"), F.lit("read"), "direct")), F.when(method.isNotNull() & F.col("register").isNotNull(), access(F.col("register"), mode, "bound")))
    return bound.select("module", "line", F.inline(F.filter(own, lambda x: x.isNotNull())))


def is_query(c: Column) -> Column:
    """Whether a text is one query that only reads: it begins with that word, comments aside."""
    return text.without_comments(c).rlike(r"(?iuU)^\s*(выбрать|select)\b")
