"""Advice on query texts: a text is cut into tokens, and every rule is a predicate on their sequence.

All is column functions: tokens are an array, a rule looks for neighbours in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the query language in its two spellings.
SELECT, UNION, JOIN, FULL = ("ВЫБРАТЬ", "SELECT"), ("ОБЪЕДИНИТЬ", "UNION"), ("СОЕДИНЕНИЕ", "JOIN"), ("ПОЛНОЕ", "FULL")
SIDED, ON = ("ЛЕВОЕ", "ПРАВОЕ", "LEFT", "RIGHT", *FULL), ("ПО", "ON")
SKIPPED = ("РАЗРЕШЕННЫЕ", "ALLOWED", "РАЗЛИЧНЫЕ", "DISTINCT", "ВНЕШНЕЕ", "OUTER")
TOP, AUTO_ORDER = ("ПЕРВЫЕ", "TOP"), ("АВТОУПОРЯДОЧИВАНИЕ", "AUTOORDER")
WHERE, OR, LIKE = ("ГДЕ", "WHERE"), ("ИЛИ", "OR"), ("ПОДОБНО", "LIKE")
SUM, IS, NULL, ISNULL = ("СУММА", "SUM"), ("ЕСТЬ", "IS"), ("NULL",), ("ЕСТЬNULL", "ISNULL")
CLAUSES = ("СГРУППИРОВАТЬ", "GROUP", "УПОРЯДОЧИТЬ", "ORDER", "ИМЕЮЩИЕ", "HAVING", "ИТОГИ", "TOTALS", *UNION, *SELECT)
VIRTUAL = ("ОСТАТКИ", "BALANCE", "ОБОРОТЫ", "TURNOVERS", "ОСТАТКИИОБОРОТЫ", "BALANCEANDTURNOVERS", "СРЕЗПОСЛЕДНИХ", "SLICELAST", "СРЕЗПЕРВЫХ", "SLICEFIRST")
PERIOD_FUNCTIONS = ("ГОД", "YEAR", "КВАРТАЛ", "QUARTER", "МЕСЯЦ", "MONTH", "ДЕНЬ", "DAY", "НАЧАЛОПЕРИОДА", "BEGINOFPERIOD", "КОНЕЦПЕРИОДА", "ENDOFPERIOD")
RECORDER = ("РЕГИСТРАТОР", "RECORDER")

TOKEN = r'//[^\n]*|"[^"]*"|[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}_][\p{L}\p{N}_]*)*|\p{N}+|[^\s\p{L}\p{N}]'


def tokens(text: Column) -> Column:
    """Upper-case tokens without comments and words that change no rule; a dotted name is one token."""
    found = F.regexp_extract_all(F.upper(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda x: ~x.startswith("//") & ~x.isin(*SKIPPED))


def _has(toks: Column, *steps) -> Column:
    """Whether tokens stand side by side that each meet their step (words, or a predicate)."""
    tests = [s if callable(s) else (lambda x, s=s: x.isin(*s)) for s in steps]

    def at(_: Column, i: Column) -> Column:
        ok = F.lit(True)
        for k, test in enumerate(tests):
            ok = ok & F.coalesce(test(F.get(toks, i + k)), F.lit(False))
        return ok

    return F.size(F.filter(toks, at)) > 0


def _virtual(x: Column) -> Column:
    return x.contains(".") & F.element_at(F.split(x, r"\."), -1).isin(*VIRTUAL)


def _dotted(x: Column) -> Column:
    return x.contains(".") & (F.length(x) > 1)


def rules(toks: Column) -> list[tuple[str, Column]]:
    """Name and predicate of every rule."""
    bare = F.filter(toks, lambda x, i: ~x.isin(*TOP) & ~F.coalesce(F.get(toks, i - 1).isin(*TOP), F.lit(False)))
    joins = F.filter(toks, lambda x: x.isin(*JOIN, *ON, *UNION))
    where = F.array_max(F.transform(toks, lambda x, i: F.when(x.isin(*WHERE), i)))
    condition = F.filter(toks, lambda x, i: (i > where) & ~F.exists(F.slice(toks, where + 2, F.greatest(i - where, F.lit(0))), lambda y: y.isin(*CLAUSES)))
    fields = F.filter(condition, lambda x: _dotted(x) | x.isin(*OR))
    null = F.exists(toks, lambda x: x.isin(*ISNULL)) | _has(toks, IS, NULL)

    def filtered(x: Column, i: Column) -> Column:
        close = F.array_position(F.slice(toks, i + 2, F.size(toks)), ")")  # counted from the opening bracket
        return x.isin(*PERIOD_FUNCTIONS) & F.coalesce((F.get(toks, i + 1) == "(") & _dotted(F.get(toks, i + 2)) & F.get(toks, (i + 1 + close).cast("int")).isin("=", "<", ">"), F.lit(False))

    def unlimited(x: Column, i: Column) -> Column:
        return _virtual(x) & ~F.coalesce((F.get(toks, i + 1) == "(") & (F.get(toks, i + 2) != ")"), F.lit(False))

    def recorder(x: Column) -> Column:
        parts = F.split(x, r"\.")
        return _dotted(x) & F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p.isin(*RECORDER))

    def across(x: Column, i: Column) -> Column:
        return x.isin(*OR) & F.coalesce(F.get(fields, i - 1) != F.get(fields, i + 1), F.lit(False))

    return [
        ("SelectStar", _has(bare, SELECT, ("*",))),
        ("JoinWithSubquery", _has(toks, JOIN, ("(",))),
        ("FullOuterJoin", _has(toks, FULL, JOIN)),
        ("UnionWithoutAll", _has(toks, UNION, SELECT)),
        ("SumAsCount", _has(toks, SUM, ("(",), ("1",), (")",))),
        ("VirtualTableNoParams", F.size(F.filter(toks, unlimited)) > 0),
        ("VirtualTablesJoined", _has(toks, JOIN, _virtual)),
        ("CompositeDereference", F.exists(toks, recorder)),
        ("FunctionOnFilterField", F.size(F.filter(toks, filtered)) > 0),
        ("OuterJoinWithoutIsNull", _has(toks, SIDED, JOIN) & ~null),
        ("LeadingWildcardLike", _has(toks, LIKE, lambda x: x.startswith('"%'))),
        ("NestedJoin", _has(joins, JOIN, JOIN)),
        ("TopWithAutoOrder", F.exists(toks, lambda x: x.isin(*TOP)) & F.exists(toks, lambda x: x.isin(*AUTO_ORDER))),
        ("OrAcrossFields", where.isNotNull() & (F.size(F.filter(fields, across)) > 0)),
    ]


def query_advice(queries: DataFrame) -> DataFrame:
    """``id``, ``rule`` for every rule that a query's ``text`` breaks."""
    cut = queries.select("id", tokens(F.col("text")).alias("toks"))
    found = [F.when(holds, name) for name, holds in rules(F.col("toks"))]
    return cut.select("id", F.explode(F.array_compact(F.array(*found))).alias("rule"))


def unindexed_filters(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """``id``, ``field``: dotted fields that a query's condition names and no index begins with.

    ``fields`` have ``field`` (upper case, as queries write it) and ``indexed``.
    """
    toks = F.col("toks")
    where = F.array_max(F.transform(toks, lambda x, i: F.when(x.isin(*WHERE), i)))
    named = F.array_distinct(F.filter(F.slice(toks, where + 2, F.size(toks)), _dotted))
    cut = queries.select("id", tokens(F.col("text")).alias("toks")).select("id", F.explode(F.when(where.isNotNull(), named)).alias("field"))
    return cut.join(fields.where("NOT indexed").select("field"), "field").select("id", "field")
