"""Registered query: advice on queries that needs their scopes, with its SQL.

A query stands for each part, of one of five shapes, over tables, fields and dimensions that follow from its
numbers. The SQL works out from the numbers what must be found; it reads no query text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scopes
from ..sources import tables as t
from ..sources.shared import parted
from .queries import query

#: Parts whose texts one task reads: each becomes many tokens.
PART = 20_000

# What the texts name: table t of four (fields F0 to F6, every third indexed), register r of three (dimensions D1 to D3).
_SHAPES = [
    "ВЫБРАТЬ А.Код ИЗ Справочник.T%1$d КАК А ЛЕВОЕ СОЕДИНЕНИЕ Справочник.T%2$d КАК Б ПО (А.F%3$d = Б.F%4$d) И А.F0 = &П СГРУППИРОВАТЬ ПО А.F5",
    "ВЫБРАТЬ А.Код ИЗ Справочник.T%1$d А СОЕДИНЕНИЕ (ВЫБРАТЬ А.F1 КАК Х ИЗ Справочник.T%2$d КАК А ГДЕ А.F%4$d = 1 УПОРЯДОЧИТЬ ПО А.F2) КАК Б ПО Б.Х = А.F%3$d",
    "ВЫБРАТЬ Р.Ресурс ИЗ РегистрНакопления.R%5$d КАК Р ГДЕ Р.D%6$d = &А И Р.Прочее > 1",
    "ВЫБРАТЬ Р.Ресурс ИЗ РегистрНакопления.R%5$d.Остатки(&Дата, D1 = &Б) КАК Р ГДЕ Р.D%6$d В (&А)",
    "ВЫБРАТЬ Р.Ресурс ИЗ РегистрНакопления.R%5$d.Остатки(&Дата, D%6$d.Вид = &А) КАК Р",
]
_NUMBERS = "q AS (SELECT p_partkey AS id, p_partkey % 5 AS shape, p_partkey % 4 AS a, p_size % 4 AS b, p_partkey % 7 AS x, p_size % 7 AS y, p_size % 3 AS r, 1 + p_partkey % 3 AS d FROM part)"


@query(f"""WITH {_NUMBERS}, named AS (SELECT id, a AS t, x AS f FROM q WHERE shape < 2 UNION SELECT id, b, y FROM q WHERE shape = 0 UNION SELECT id, a, 0 FROM q WHERE shape = 0)
SELECT id, 'UnindexedJoin' AS rule, 'СПРАВОЧНИК.T' || t AS "table", 'F' || f AS field FROM named WHERE (t + f) % 3 <> 0
UNION ALL SELECT id, 'NonLeadingDimensionFilter', 'РЕГИСТРНАКОПЛЕНИЯ.R' || r, 'D' || d FROM q WHERE shape IN (2, 4) AND d > 1
UNION ALL SELECT id, 'VirtualTableFilterInWhere', 'РЕГИСТРНАКОПЛЕНИЯ.R' || r, 'D' || d FROM q WHERE shape = 3 AND d > 1
UNION ALL SELECT id, 'VirtualTableComplexParams', 'РЕГИСТРНАКОПЛЕНИЯ.R' || r, 'D' || d || '.ВИД' FROM q WHERE shape = 4""")
def scope_advice(s, d):
    """Joins without index, filters past the first dimension, and parameters of virtual tables."""
    k, z = F.col("p_partkey"), F.col("p_size")
    numbers = [k % 4, z % 4, k % 7, z % 7, z % 3, 1 + k % 3]
    own = F.lit(None).cast("string")
    for i, form in enumerate(_SHAPES):
        own = F.when(k % 5 == i, F.format_string(form, *numbers)).otherwise(own)
    numbered = s.range(28).select(F.floor(F.col("id") / 7).cast("long").alias("t"), (F.col("id") % 7).alias("f"))
    fields = numbered.select(F.concat(F.lit("СПРАВОЧНИК.T"), "t").alias("table"), F.concat(F.lit("F"), "f").alias("field"), ((F.col("t") + F.col("f")) % 3 == 0).alias("indexed"))
    dims = s.range(9).select(F.concat(F.lit("РЕГИСТРНАКОПЛЕНИЯ.R"), F.floor(F.col("id") / 3).cast("long")).alias("table"), F.concat(F.lit("D"), F.col("id") % 3 + 1).alias("field"), (F.col("id") % 3 + 1).alias("position"))
    p = t.table(s, d, "part").select("p_partkey", "p_size")
    return scopes.scope_advice(parted(p, "p_partkey", p.count(), PART).select(k.alias("id"), own.alias("text")), fields, dims)
