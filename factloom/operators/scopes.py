"""Advice on queries that needs their scopes: which table an alias stands for, and its indexes.

The tokens of a text become rows. A bracket that begins with a select opens a scope, which its own
bracket closes; the select that a token belongs to is the last one at its depth of such brackets, and its
clause is the last keyword in that scope. Aliases are bound to tables within their scope, then fields
join with their tables' indexes, dimensions and parameters by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import kept
from .advice import JOIN, ON, SELECT, UNION, VIRTUAL, WHERE, tokens

# Words of the query language in its two spellings.
FROM, AS, IN, HIERARCHY = ("ИЗ", "FROM"), ("КАК", "AS"), ("В", "IN"), ("ИЕРАРХИИ", "HIERARCHY")
OTHER = ("СГРУППИРОВАТЬ", "GROUP", "УПОРЯДОЧИТЬ", "ORDER", "ИМЕЮЩИЕ", "HAVING", "ИТОГИ", "TOTALS", "ИНДЕКСИРОВАТЬ", "INDEX")
SIDES = ("ЛЕВОЕ", "ПРАВОЕ", "ПОЛНОЕ", "ВНУТРЕННЕЕ", "LEFT", "RIGHT", "FULL", "INNER")
#: First parts of tables, which are no fields.
KINDS = ("СПРАВОЧНИК", "ДОКУМЕНТ", "РЕГИСТРНАКОПЛЕНИЯ", "РЕГИСТРСВЕДЕНИЙ", "ПЕРЕЧИСЛЕНИЕ", "ПЛАНВИДОВХАРАКТЕРИСТИК", "CATALOG", "DOCUMENT", "ACCUMULATIONREGISTER", "INFORMATIONREGISTER", "ENUM")


def _ordered(*by: str) -> W:
    return W.partitionBy("id", *by).orderBy("pos")


def _upto(*by: str) -> W:
    return _ordered(*by).rowsBetween(W.unboundedPreceding, 0)


def scoped(queries: DataFrame) -> DataFrame:
    """Tokens of every query: ``id, pos, tok, level, scope, clause, base`` and the four tokens after each (``t1``...).

    ``level`` counts brackets around a token, ``scope`` is the place of its select, ``base`` that select's level.
    """
    cut = queries.select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "tok"))
    tok = F.col("tok")
    step = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)
    toks = cut.select("*", *[F.lead("tok", n).over(_ordered()).alias(f"t{n}") for n in range(1, 5)], F.lag("tok").over(_ordered()).alias("b1"))
    toks = toks.withColumn("level", (F.sum(step).over(_upto()) - (tok == "(").cast("int")).cast("int"))
    bracket = tok.isin("(", ")")
    opens = (tok == "(") & F.col("t1").isin(*SELECT)
    toks = toks.withColumn("_bracket", bracket).withColumn("_opens", F.coalesce(opens, F.lit(False)))
    # brackets of one level come in pairs: what closes is what opened before
    shuts = (tok == ")") & F.coalesce(F.lag("_opens").over(_ordered("level", "_bracket")), F.lit(False))
    toks = toks.withColumn("close", F.when(tok == "(", F.lead("pos").over(_ordered("level", "_bracket"))))
    toks = toks.withColumn("_shuts", shuts)
    toks = toks.withColumn("depth", F.sum(F.when(F.col("_opens"), 1).when(F.col("_shuts"), -1).otherwise(0)).over(_upto()))
    starts = tok.isin(*SELECT)
    last = lambda c, *by: F.last(c, ignorenulls=True).over(_upto(*by))
    toks = toks.withColumn("scope", last(F.when(starts, F.col("pos")), "depth")).withColumn("base", last(F.when(starts, F.col("level")), "depth"))
    name = F.when(tok.isin(*SELECT), "select").when(tok.isin(*FROM), "from").when(tok.isin(*JOIN), "join").when(tok.isin(*WHERE), "where").when(tok.isin(*OTHER), "other").when(tok.isin(*UNION), "union").when(tok == ";", "end")
    at_base = F.col("level") == F.col("base")
    toks = toks.withColumn("_main", last(F.when(at_base, name), "depth", "scope"))
    on = tok.isin(*ON) & at_base & (F.col("_main") == "join")
    toks = toks.withColumn("clause", last(F.when(on, "on").when(at_base, name), "depth", "scope"))
    return toks.drop("_bracket", "_opens", "_shuts", "_main")


def sources(toks: DataFrame) -> DataFrame:
    """Tables of every scope: ``id, scope, at, table, virtual, alias, open, close`` (brackets of its parameters, if any)."""
    dotted = F.col("tok").rlike(r"^[\p{L}_][\p{L}\p{N}_]*\.")
    first = dotted & F.col("clause").isin("from", "join") & (F.col("level") == F.col("base")) & (F.col("b1").isin(*FROM, *JOIN, ","))
    found = toks.where(first).select("id", "scope", F.col("pos").alias("at"), "tok", "t1", "t2")
    brackets = toks.where("tok = '('").select("id", (F.col("pos") - 1).alias("at"), F.col("pos").alias("open"), "close", F.col("t1").alias("inside"))
    found = found.join(brackets, ["id", "at"], "left")
    after = toks.select("id", F.col("pos").alias("close"), F.col("t1").alias("c1"), F.col("t2").alias("c2"))
    found = found.join(after, ["id", "close"], "left")
    n1, n2 = F.when(F.col("open").isNotNull(), F.col("c1")).otherwise(F.col("t1")), F.when(F.col("open").isNotNull(), F.col("c2")).otherwise(F.col("t2"))
    plain = n1.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & ~n1.isin(*JOIN, *ON, *WHERE, *OTHER, *UNION, *SIDES)
    parts = F.split("tok", r"\.")
    alias = F.when(n1.isin(*AS), n2).when(plain, n1).otherwise(F.element_at(parts, -1))
    return found.select("id", "scope", "at", F.array_join(F.slice(parts, 1, 2), ".").alias("table"), F.when((F.size(parts) > 2) & F.element_at(parts, -1).isin(*VIRTUAL), F.element_at(parts, -1)).alias("virtual"), alias.alias("alias"), F.when(F.col("inside") != ")", F.col("open")).alias("open"), "close")


def _fields(toks: DataFrame, *clauses: str) -> DataFrame:
    """Fields with an alias in some clauses: ``id, scope, alias, field``, and whether a parameter is compared with them."""
    parts = F.split("tok", r"\.")
    compared = ((F.col("t1") == "=") & ((F.col("t2") == "&") | ((F.col("t2") == "(") & (F.col("t3") == "&")))) | (F.col("t1").isin(*IN) & ((F.col("t2") == "&") | ((F.col("t2") == "(") & (F.col("t3") == "&")) | (F.col("t2").isin(*HIERARCHY) & (F.col("t3").isin("&") | ((F.col("t3") == "(") & (F.col("t4") == "&"))))))
    named = toks.where(F.col("clause").isin(*clauses) & F.col("tok").rlike(r"^[\p{L}_][\p{L}\p{N}_]*\.") & (F.coalesce(F.col("b1"), F.lit("")) != "&"))
    return named.select("id", "scope", F.get(parts, F.lit(0)).alias("alias"), F.get(parts, F.lit(1)).alias("field"), F.coalesce(compared, F.lit(False)).alias("compared"))


def scope_advice(queries: DataFrame, fields: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``id, rule, table, field`` of the rules that need scopes.

    ``queries`` have id and text; ``fields`` table, field and indexed; ``dimensions`` table, field and position
    (from 1); names in upper case. UnindexedJoin: a join's condition names a field of a known table without index.
    NonLeadingDimensionFilter: a register is filtered by a dimension that is not its first, and not by its
    first. VirtualTableFilterInWhere: a dimension is compared with a parameter after a virtual table with
    parameters, not within them. VirtualTableComplexParams: a virtual table's parameters join tables or reach
    through a dot. One row a source for the last three.
    """
    toks = kept(scoped(queries))
    own = kept(sources(toks))
    bound = own.select("id", "scope", "alias", "at", "table", "virtual", "open")
    joins = _fields(toks, "on").join(bound, ["id", "scope", "alias"])
    known = fields.select("table", "field", F.col("indexed"))
    bare = joins.join(fields.select("table").distinct(), "table", "left_semi").join(known.where("indexed"), ["table", "field"], "left_anti")
    row = lambda df, rule: df.select("id", F.lit(rule).alias("rule"), "table", "field")
    out = row(bare, "UnindexedJoin").distinct()
    # names within a table's parameters, whatever scope they are in
    inside = toks.select("id", "pos", "tok", "b1").join(own.where("open IS NOT NULL").select("id", "at", "table", "virtual", "open", F.coalesce("close", F.lit(1 << 30)).alias("close")), "id").where((F.col("pos") > F.col("open")) & (F.col("pos") < F.col("close")))
    inside = kept(inside.select("id", "at", "table", "virtual", "tok", "b1", "pos"))
    first = F.get(F.split("tok", r"\."), F.lit(0))
    in_params = inside.where(F.coalesce(F.col("b1"), F.lit("")) != "&").select("id", "at", "table", first.alias("field")).distinct()
    where = _fields(toks, "where").join(bound, ["id", "scope", "alias"])
    filtered = where.select("id", "at", "table", "field").union(in_params).distinct().join(dimensions, ["table", "field"])
    least = filtered.groupBy("id", "at", "table").agg(F.min(F.struct("position", "field")).alias("m")).where("m.position > 1")
    out = out.union(row(least.withColumn("field", F.col("m.field")), "NonLeadingDimensionFilter"))
    late = where.where("compared AND virtual IS NOT NULL AND open IS NOT NULL").select("id", "at", "table", "field").distinct().join(dimensions, ["table", "field"]).join(in_params, ["id", "at", "table", "field"], "left_anti")
    late = late.groupBy("id", "at", "table").agg(F.min(F.struct("position", "field")).alias("m")).withColumn("field", F.col("m.field"))
    out = out.union(row(late, "VirtualTableFilterInWhere"))
    dotted = F.col("tok").rlike(r"^[\p{L}_][\p{L}\p{N}_]*\.") & ~first.isin(*KINDS) & (F.coalesce(F.col("b1"), F.lit("")) != "&")
    deep = inside.where("virtual IS NOT NULL").groupBy("id", "at", "table", "virtual").agg(F.bool_or(F.col("tok").isin(*SELECT)).alias("selects"), F.bool_or(F.col("tok").isin(*JOIN)).alias("joins"), F.min_by("tok", F.when(dotted, F.col("pos"))).alias("through"))
    joined = F.col("selects") & F.col("joins")
    deep = deep.where(joined | (F.col("through").isNotNull() & ~F.col("selects"))).withColumn("field", F.when(joined, F.col("virtual")).otherwise(F.col("through")))
    return out.union(row(deep, "VirtualTableComplexParams"))

