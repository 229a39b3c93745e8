"""Readers of XML exports and stream operators on small fixtures."""

import datetime

from factloom.operators import audits, routes
from factloom.sources import exports
from factloom.streaming import logs

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<MetaDataObject xmlns="http://example.org/classes" xmlns:v8="http://example.org/core">'
CATALOG = HEAD + """<Catalog uuid="1"><Properties><Name>Goods</Name><Synonym><v8:item><v8:lang>en</v8:lang><v8:content>All goods</v8:content></v8:item></Synonym></Properties>
<ChildObjects><Attribute uuid="2"><Properties><Name>Unit</Name><Type><v8:Type>cfg:CatalogRef.Units</v8:Type><v8:Type>xs:string</v8:Type></Type></Properties></Attribute>
<TabularSection uuid="3"><Properties><Name>Parts</Name></Properties></TabularSection></ChildObjects></Catalog></MetaDataObject>"""
SUBSCRIPTION = HEAD + """<EventSubscription uuid="4"><Properties><Name>Watch</Name><Source><v8:Type>cfg:CatalogObject.Goods</v8:Type><v8:TypeSet>cfg:DocumentObject</v8:TypeSet><v8:TypeSet>cfg:DefinedType.Any</v8:TypeSet></Source><Event>BeforeWrite</Event><Handler>CommonModule.M.H</Handler></Properties></EventSubscription></MetaDataObject>"""
SUBSYSTEM = HEAD + """<Subsystem uuid="5"><Properties><Name>Trade</Name><Content><Item>Catalog.Goods</Item><Item> </Item></Content></Properties><ChildObjects><Subsystem>Retail</Subsystem></ChildObjects></Subsystem></MetaDataObject>"""
RIGHTS = """<?xml version="1.0" encoding="UTF-8"?>
<Rights xmlns="http://example.org/roles"><setForNewObjects>true</setForNewObjects><object><name>Catalog.Goods</name>
<right><name>Read</name><value>true</value><restrictionByCondition><condition>WHERE x</condition></restrictionByCondition></right>
<right><name>Insert</name><value>false</value></right></object></Rights>"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_export_readers(spark, tmp_path):
    for path, body in {"Catalogs/Goods.xml": CATALOG, "EventSubscriptions/Watch.xml": SUBSCRIPTION, "Subsystems/Trade.xml": SUBSYSTEM, "Roles/Seller/Ext/Rights.xml": RIGHTS, "Catalogs/Broken.xml": "<MetaDataObject><Catalog>", "Catalogs/Empty.xml": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body, "utf-8")
    root = str(tmp_path)
    found = exports.objects(spark, root)
    assert rows(found.select("kind", "name", "synonym")) == [("Catalog", "Goods", "All goods")]
    assert rows(exports.members(found)) == [("Catalog", "Goods", "Attribute", "Unit", ["CatalogRef.Units", "string"]), ("Catalog", "Goods", "TabularSection", "Parts", [])]
    assert rows(exports.subscriptions(spark, root)) == [("Watch", "BeforeWrite", "CommonModule.M.H", k, x) for k, x in (("defined", "Any"), ("kind", "DocumentObject"), ("type", "CatalogObject.Goods"))]
    assert rows(exports.subsystems(spark, root)) == [("Trade", "child", "Retail"), ("Trade", "object", "Catalog.Goods")]
    assert rows(exports.rights(spark, root)) == [("Seller", True, "Catalog.Goods", "Insert", False, False), ("Seller", True, "Catalog.Goods", "Read", True, True)]


def test_stream_drops_repeats_and_closes_hours(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    data = [(1, at, "a"), (1, at, "a"), (2, at + datetime.timedelta(minutes=59), "a"), (3, at + datetime.timedelta(hours=3), "b")]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/in")
    log = lambda: logs.entries(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz, event_type string", "10 minutes")
    assert rows(logs.run_available(logs.once(log(), "event_id")).select("event_id")) == [(1,), (2,), (3,)]
    assert rows(logs.run_available(logs.hours(log())).select("hour", "event_type", "n")) == [(at, "a", 3)]


def test_templates_and_hosts_with_nulls_and_empty_tables(spark):
    calls = spark.createDataFrame([(1, "http://h/a/b"), (2, "http://h/"), (3, None)], "id int, url string")
    ends = spark.createDataFrame([("x", "/a/{p}"), ("y", "/a/*"), ("z", "/")], "endpoint string, pattern string")
    assert {r.id: r.endpoint for r in routes.matched_templates(calls, ends).collect()} == {1: "x", 2: "z", 3: None}
    assert {r.endpoint for r in routes.matched_templates(calls, ends.limit(0)).collect()} == {None}
    hosts = spark.createDataFrame([("a.b",), (None,), ("",)], "host string")
    rules = spark.createDataFrame([("*b", "p"), ("*.b", "q")], "rule string, project string")
    assert {r.host: r.project for r in routes.mapped_hosts(hosts, rules).collect()} == {"a.b": "q", None: None, "": None}


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate([5, 9, 4, 2])], "section string, id long, cost long")
    assert rows(audits.packed(df, "section", 10, 10)) == [("s", 0, 5), ("s", 2, 9)]
