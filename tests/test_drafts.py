"""Comments above routines, and drafts against ready methods."""

from factloom.operators import drafts


def test_comments_above_routines(spark):
    text = "// не здесь\n\n// Первая строка\n//\n//   Вторая\n&НаКлиенте\nПроцедура А()\n\t// внутри\nКонецПроцедуры // сзади\nФункция Б()\nКонецФункции\n//\n// Итог\nАсинх Функция В() КонецФункции\n// Далеко\n\nПроцедура Г()"
    got = {x.routine: (x.line, x.doc, x.summary) for x in drafts.documented(spark.createDataFrame([(1, text), (2, "Процедура А()"), (3, "")], "module int, text string")).where("module = 1").collect()}
    assert got == {"А": (7, "Первая строка\n\nВторая", "Первая строка"), "Б": (10, "", ""), "В": (14, "\nИтог", "Итог"), "Г": (17, "", "")}


def test_ready_methods_for_drafts(spark):
    make = spark.createDataFrame
    own = make([(1, "РазложитьСтрокуВМассив", "", "m"), (2, "ПолучитьКурсыВалют", "загрузка курсов валюты с сайта", "m"), (3, "Считать", "", "m"), (4, "УдалитьФайлы", "", "Файлы")], "draft int, name string, doc string, owner string")
    methods = make([
        (10, "Строки", True, False, "РазложитьСтрокуВМассивПодстрок", ""), (11, "Строки", True, True, "РазложитьСтроку", ""), (12, "Прочее", False, False, "РазложитьМассив", "строку"),
        (13, "Валюты", False, False, "ЗагрузитьКурсыВалют", ""), (14, "Валюты", False, False, "КурсДоллара", "курсы валют"), (15, "Файлы", False, False, "УдалитьФайл", ""), (16, "Диск", False, False, "УдаленияФайлов", ""), (17, "Прочее", True, False, "Строку", ""),
    ], "id int, owner string, library boolean, deprecated boolean, name string, summary string")
    got = {(x.draft, x.section, x.id) for x in drafts.ready_made(own, methods, 8).collect()}
    assert got == {(1, "library", 10), (1, "other", 12), (2, "other", 13), (4, "other", 16)}
    names = make([("ПриОткрытии",), ("ОбработкаПроведения",), ("Приём",), ("OnOpen",)], "n string")
    assert [x[0] for x in names.select(drafts.is_handler(names["n"])).collect()] == [True, True, False, True]


def test_heavy_rows_are_parted_by_their_number(spark, monkeypatch):
    from factloom.operators import search
    from factloom.plans import QUERIES, audits, scoped

    for module in (audits, scoped):
        monkeypatch.setattr(module, "PART", 10)
    monkeypatch.setattr(search, "METHODS", 10)
    monkeypatch.setattr(search, "HITS", 1_000)
    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/part.parquet").count()
    assert QUERIES["query_advice"](spark, folder).rdd.getNumPartitions() == parts // 10 + 1
    for name in ("fielded_search", "scope_advice", "draft_check", "query_advice", "ready_methods", "find_api"):
        seen = []
        own = search.parted
        for module in (search, audits, scoped, __import__("factloom.operators.drafts", fromlist=["x"])):
            monkeypatch.setattr(module, "parted", lambda df, key, rows, each, own=own: seen.append(key) or own(df, key, rows, each))
        assert QUERIES[name](spark, folder).count() > 0 and seen, name
        for module in (search, audits, scoped, __import__("factloom.operators.drafts", fromlist=["x"])):
            monkeypatch.setattr(module, "parted", own)
