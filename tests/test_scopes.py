"""Advice that needs scopes: aliases by brackets, joins, dimensions, parameters of virtual tables."""

import pytest

from factloom.operators import scopes

FIELDS = [("СПРАВОЧНИК.ТОВАРЫ", "ССЫЛКА", True), ("СПРАВОЧНИК.ТОВАРЫ", "КОД", True), ("СПРАВОЧНИК.ТОВАРЫ", "ЕДИНИЦА", False), ("ДОКУМЕНТ.ЗАКАЗ", "ССЫЛКА", True)]
DIMENSIONS = [("РЕГИСТРНАКОПЛЕНИЯ.ЗАПАС", "ОРГАНИЗАЦИЯ", 1), ("РЕГИСТРНАКОПЛЕНИЯ.ЗАПАС", "ТОВАР", 2), ("РЕГИСТРНАКОПЛЕНИЯ.ЗАПАС", "СКЛАД", 3)]
T, R = "СПРАВОЧНИК.ТОВАРЫ", "РЕГИСТРНАКОПЛЕНИЯ.ЗАПАС"
CASES = [
    ("ВЫБРАТЬ Т.Ссылка ИЗ Справочник.Товары КАК Т ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Товары КАК П ПО П.Единица = Т.Единица", {("UnindexedJoin", T, "ЕДИНИЦА")}),
    ("ВЫБРАТЬ Т.Ссылка ИЗ Справочник.Товары КАК Т ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Товары КАК П ПО П.Ссылка = Т.Ссылка УПОРЯДОЧИТЬ ПО Т.Единица", set()),
    ("ВЫБРАТЬ Т.Ссылка ИЗ Справочник.Товары КАК Т ЛЕВОЕ СОЕДИНЕНИЕ (ВЫБРАТЬ П.Единица КАК Е ИЗ Справочник.Товары КАК П СГРУППИРОВАТЬ ПО П.Единица) КАК В ПО В.Е = Т.Код ГДЕ Т.Единица = 1", set()),
    # an alias that a subquery uses again is told apart
    ("ВЫБРАТЬ Т.Код ИЗ Справочник.Товары Т ЛЕВОЕ СОЕДИНЕНИЕ (ВЫБРАТЬ З.Код ИЗ Справочник.Товары КАК Т СОЕДИНЕНИЕ Документ.Заказ З ПО З.Ссылка = Т.Код ГДЕ Т.Единица = 1) КАК В ПО (В.Код = Т.Единица)", {("UnindexedJoin", T, "ЕДИНИЦА")}),
    ("SELECT a.x FROM Unknown.Table AS a JOIN Other.Table AS b ON a.x = b.y", set()),
    ("ВЫБРАТЬ О.Товар ИЗ РегистрНакопления.Запас.Остатки(&Дата, Товар = &Т) КАК О", {("NonLeadingDimensionFilter", R, "ТОВАР")}),
    ("ВЫБРАТЬ О.Товар ИЗ РегистрНакопления.Запас.Остатки(&Дата, Товар = &Т И Организация В (&О)) КАК О", set()),
    ("ВЫБРАТЬ О.Товар ИЗ РегистрНакопления.Запас КАК О ГДЕ О.Склад = &С ИЛИ О.Товар = 1", {("NonLeadingDimensionFilter", R, "ТОВАР")}),
    ("ВЫБРАТЬ О.Товар ИЗ РегистрНакопления.Запас.Остатки(&Дата, Организация = &О) КАК О ГДЕ О.Склад В ИЕРАРХИИ (&С)", {("VirtualTableFilterInWhere", R, "СКЛАД")}),
    ("ВЫБРАТЬ О.Товар ИЗ РегистрНакопления.Запас.Остатки(&Дата, Организация = &О) КАК О ГДЕ О.Склад = О.Товар", set()),
    ("ВЫБРАТЬ О.Товар ИЗ РегистрНакопления.Запас.Остатки(&Дата, Организация.Вид = &О) КАК О", {("VirtualTableComplexParams", R, "ОРГАНИЗАЦИЯ.ВИД")}),
    ("ВЫБРАТЬ 1 ИЗ РегистрНакопления.Запас.Остатки(, Организация В (ВЫБРАТЬ Т.Код ИЗ Справочник.Товары КАК Т ВНУТРЕННЕЕ СОЕДИНЕНИЕ Документ.Заказ КАК З ПО З.Ссылка = Т.Ссылка)) КАК О", {("VirtualTableComplexParams", R, "ОСТАТКИ")}),
    ("ВЫБРАТЬ 1 ИЗ РегистрНакопления.Запас.Остатки(&Дата, Организация ССЫЛКА Справочник.Товары) КАК О", set()),
    ("ВЫБРАТЬ Т.Код ИЗ Справочник.Товары КАК Т СОЕДИНЕНИЕ Справочник.Товары КАК П ПО П.Код = Т.Код; ВЫБРАТЬ 1 ИЗ Документ.Заказ КАК Т СОЕДИНЕНИЕ Документ.Заказ КАК П ПО П.Единица = Т.Ссылка", {("UnindexedJoin", "ДОКУМЕНТ.ЗАКАЗ", "ЕДИНИЦА")}),
    ("ВЫБРАТЬ Т.Код ИЗ Справочник.Товары КАК Т ОБЪЕДИНИТЬ ВСЕ ВЫБРАТЬ З.Код ИЗ Справочник.Товары КАК З СОЕДИНЕНИЕ Документ.Заказ КАК Т ПО Т.Ссылка = З.Единица", {("UnindexedJoin", T, "ЕДИНИЦА")}),
    (")( ВЫБРАТЬ ИЗ ПО (((", set()),
    ("", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "id int, text string")
    got: dict = {}
    for x in scopes.scope_advice(df, spark.createDataFrame(FIELDS, "table string, field string, indexed boolean"), spark.createDataFrame(DIMENSIONS, "table string, field string, position int")).collect():
        got.setdefault(x.id, []).append((x.rule, x.table, x.field))
    return got


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scope_advice(found, k):
    own = found.get(k, [])
    assert set(own) == CASES[k][1] and len(own) == len(CASES[k][1]), CASES[k][0]
