"""Readers of files, forms, predefined items, jobs and code on small examples."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import advice, code, graph, search
from factloom.sources import exports, files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def root(tmp_path):
    def put(path, content):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content, encoding="utf-8")

    put("Catalogs/Goods/Forms/Item/Ext/Form.xml", """<Form xmlns="http://x/logform"><Events><Event name="OnOpen">Opened</Event></Events>
<ChildItems><UsualGroup name="Top" id="1"><ChildItems><InputField name="Code" id="2"><DataPath>Object.Code</DataPath><Events><Event name="OnChange">CodeChanged</Event></Events></InputField></ChildItems></UsualGroup></ChildItems>
<Attributes><Attribute name="Object"><Type><v8:Type xmlns:v8="http://v8">cfg:CatalogObject.Goods</v8:Type></Type></Attribute></Attributes><Commands><Command name="Fill"><Action>FillIt</Action></Command></Commands></Form>""")
    put("Catalogs/Goods/Ext/Predefined.xml", """<PredefinedData xmlns="http://x"><Item id="1"><Name>Food</Name><Code>1</Code><Description>All food</Description><IsFolder>true</IsFolder><ChildItems><Item id="2"><Name>Milk</Name><Code>2</Code><Description/><IsFolder>false</IsFolder></Item></ChildItems></Item></PredefinedData>""")
    put("Catalogs/Broken/Ext/Form.xml", "<Form><ChildItems>")
    put("ScheduledJobs/Night.xml", "<MetaDataObject><ScheduledJob><Properties><Name>Night</Name><MethodName>CommonModule.Jobs.Night</MethodName><Use>true</Use><Predefined>false</Predefined></Properties></ScheduledJob></MetaDataObject>")
    put("CommonModules/Jobs/Ext/Module.bsl", "Procedure Night() Export\nEndProcedure")
    put(".git/config", "x")
    return str(tmp_path)


def test_forms_nest(spark, root):
    got = rows(exports.form_items(spark, root), "part", "kind", "name", "parent", "detail")
    assert got == sorted([
        ("event", "Event", "OnOpen", "", "Opened"), ("item", "UsualGroup", "Top", "", ""), ("item", "InputField", "Code", "Top", "Object.Code"),
        ("event", "Event", "OnChange", "Code", "CodeChanged"), ("attribute", "Attribute", "Object", "", "CatalogObject.Goods"), ("command", "Command", "Fill", "", "FillIt"),
    ])


def test_predefined_items_and_jobs(spark, root):
    assert rows(exports.predefined(spark, root), "name", "code", "folder", "parent") == [("Food", "1", True, ""), ("Milk", "2", False, "Food")]
    assert rows(exports.scheduled_jobs(spark, root), "name", "method", "used", "predefined") == [("Night", "CommonModule.Jobs.Night", True, False)]


def test_tree_kinds_and_projects(spark, root):
    found = files.tree(spark, root, ["**/*.xml", "**/*.bsl", "*.json"], ["**/Broken/**"]).withColumn("kind", files.kind(F.col("path")))
    assert rows(found, "path", "kind") == [
        ("Catalogs/Goods/Ext/Predefined.xml", "predefined"), ("Catalogs/Goods/Forms/Item/Ext/Form.xml", "form"),
        ("CommonModules/Jobs/Ext/Module.bsl", "common module"), ("ScheduledJobs/Night.xml", "object"),
    ]
    assert rows(files.projects(files.tree(spark, root, [], [])), "folder") == [("CommonModules",), ("CommonModules/Jobs",), ("CommonModules/Jobs/Ext",)]


def test_manifest_findings(spark, tmp_path):
    c = [{"name": "base", "root": "src", "kind": "configuration"}, {"name": "ext", "root": "../up", "kind": "extension"}, {"name": "ext", "root": "b", "kind": "extension"}, {"name": "", "root": "c", "kind": "extension"}, {"name": "odd", "root": "d", "kind": "thing"}]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "components": c}))
    got = {(r.name, r.root): r.finding for r in files.manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("base", "src"): None, ("ext", "../up"): "name is not unique", ("ext", "b"): "name is not unique", ("", "c"): "name is missing", ("odd", "d"): "kind is not known"}


def test_regions_nest_and_variables_are_bound_again(spark):
    source = "\n".join([
        "#Область А", "#Область Б", "Функция Ф(а, б = \"x,y\") // Процедура Нет()", "Н = РегистрыНакопления.Один.СоздатьНаборЗаписей();", "Н = РегистрыСведений.Два.СоздатьНаборЗаписей();", "Н.Очистить();", "КонецФункции", "#КонецОбласти",
        "Процедура П() Экспорт", "Н.Записать();", "КонецПроцедуры", "#КонецОбласти", "Ф(1)",
    ])
    found = code.placed(code.lines(spark.createDataFrame([(1, source)], "module int, text string")))
    at = {r.line: (r.routine, r.region) for r in found.collect()}
    assert at[4] == ("Ф", "А/Б") and at[8] == (None, "А") and at[10] == ("П", "А") and at[13] == (None, "")
    assert rows(code.routines(found), "routine", "function", "params", "exported") == [("П", False, 0, True), ("Ф", True, 2, False)]
    assert rows(code.register_accesses(found), "line", "register", "mode") == [(6, "Два", "clear")]
    assert (13, "Ф") in rows(code.references(found), "line", "name")


def test_words_of_names_and_same_words(spark):
    df = spark.createDataFrame([("РазложитьСтрокуВМассив", "разложить строку в массив"), ("URLАдрес2Ёж", "url адрес 2 еж"), ("a_b-c12", "a b c 12"), ("", "")], "x string, want string")
    assert all(" ".join(r.t) == r.want for r in df.select("want", text.tokens(F.col("x")).alias("t")).collect())
    assert all(sorted(r.t) == sorted(set(r.want.split())) for r in df.select("want", text.distinct_tokens(F.col("x")).alias("t")).collect())
    same = [("удаление", "удалить", True), ("цена", "цену", True), ("цена", "центр", False), ("вид", "видимость", False), ("files", "file", True), ("прописью", "пропуск", False), ("ab", "ab", True), ("boxes", "box", True), ("форматирование", "форматировать", True), ("индексацию", "индексировать", True), ("загрузка", "загрузить", True), ("новый", "нового", True), ("новый", "новость", False), ("red", "reds", True), ("bus", "bus", True)]
    df = spark.createDataFrame(same, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", (text.word_key(F.col("a")) == text.word_key(F.col("b"))).alias("got")).collect())


def test_near_names_finds_all_within_two_edits(spark):
    import itertools
    import random

    r = random.Random(7)
    names = {"".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(250)}
    asked = {"".join(r.choice("abc") for _ in range(r.randint(0, 8))) for _ in range(60)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = list(itertools.accumulate(range(len(b)), lambda left, j, row=row, x=x: min(left + 1, row[j + 1] + 1, row[j] + (x != b[j])), initial=i + 1))
        return row[-1]

    got = search.near_names(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(x,) for x in names], "found string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in asked for b in names if distance(a, b) <= 2)


def test_packing_goes_on_over_blocks(spark):
    rows = [(t, "ab"[i % 2], i, (i * 7919 + t) % 50 + 1, float((i * 31) % 17)) for t in range(3) for i in range(40 + 30 * t)]
    df = spark.createDataFrame(rows, "task int, category string, id int, cost int, score double")
    whole, cut = (sorted(map(tuple, search.packed_context(df, ["b"], 300, block=n).collect())) for n in (1_000, 7))
    assert whole == cut and len(whole) == len(rows)


def test_advice_reads_tokens_not_strings(spark):
    texts = ["SELECT a.x FROM D.A AS a WHERE a.name = \"LEFT JOIN (SELECT *\"", "ВЫБРАТЬ Т.А ИЗ Р.Б.Остатки() КАК Т", "ВЫБРАТЬ Т.А ИЗ Р.Б.Остатки(&Д) КАК Т ГДЕ МЕСЯЦ(Т.Период, 1) < 3", "SELECT a.x FROM A AS a WHERE a.x = 1 OR a.x = 2"]
    got = {(r.id, r.rule) for r in advice.query_advice(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    assert got == {(1, "VirtualTableNoParams"), (2, "FunctionOnFilterField")}


def test_walk_caps_and_leaves(spark):
    e = spark.createDataFrame([("a", "b", 1, True), ("a", "c", 2, False), ("b", "d", 1, True), ("c", "x", 1, True), ("d", "a", 1, True)], "src string, dst string, order int, open boolean")
    got = {r.id: (r.depth, ">".join(r.path), r.leaf) for r in graph.walk(e, ["a"], 3).collect()}
    assert got == {"a": (0, "a", False), "b": (1, "a>b", False), "c": (1, "a>c", True), "d": (2, "a>b>d", False)}
    assert {r.id for r in graph.walk(e, ["a"], 3, node_cap=2).collect()} == {"a", "b"}
    assert {r.id for r in graph.walk(e, ["a"], 3, fan_cap=1).collect()} == {"a", "b", "d"}


def test_accesses_cut_lines_once_in_parts_of_bounded_rows(spark, monkeypatch):
    from factloom.plans import code as plan

    source = "\n".join(["Процедура П()", "Н = РегистрыСведений.Два.СоздатьНаборЗаписей();", "Н.Записать(РегистрыНакопления.Один.Остатки(А));", "КонецПроцедуры", "Н.Записать();", "Процедура Р()", "Н.Очистить();", "КонецПроцедуры"])
    found = code.register_accesses(code.placed(code.lines(spark.createDataFrame([(1, source), (2, ""), (3, None)], "module int, text string"))))
    assert rows(found, "module", "line", "register", "mode", "confidence") == [(1, 3, "Два", "write", 0.85), (1, 3, "Один", "read", 0.95)]
    monkeypatch.setattr(plan, "LINES", 300, raising=False)
    df = plan.code_accesses(spark, "/root/testdata/sf0.001")
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert [shown.count(x) for x in ("Exchange", "Generate posexplode", "FileScan parquet")] == [1, 1, 1]
    assert df.rdd.getNumPartitions() > 20
