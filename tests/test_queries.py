"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from factloom import plans
from factloom.operators import graph, relational

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, int | str | bool | type(None)) else str(v)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    found = duck.execute(plans.SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def test_reach_on_random_graphs_and_with_a_cap(spark):
    import random

    r = random.Random(1)
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(70)}
    e = spark.createDataFrame([(str(a), str(b), (a * b % 9 + 1) / 10) for a, b in pairs], "src string, dst string, confidence double")
    depth, level = {"0": 0}, ["0"]
    for k in range(1, 4):
        level = [str(b) for a, b in pairs if str(a) in level and str(b) not in depth]
        depth |= dict.fromkeys(level, k)
    start = spark.createDataFrame([("0",)], "id string")
    assert {x.id: x.depth for x in graph.reach(e, start, 3).collect()} == depth
    assert graph.reach(e, start, 3, node_cap=4).count() == min(4, len(depth))


def test_keyset_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(f"n{i % 5}", i) for i in range(23)], "name string, id long")
    seen, after = [], None
    while True:
        page = [tuple(x) for x in relational.keyset_page(df, ["name", "id"], after, 6).collect()]
        seen += page[:6]
        if len(page) <= 6:
            break
        after = page[5]
    assert seen == sorted((f"n{i % 5}", i) for i in range(23))


def test_shortest_paths_look_no_further_than_the_target(spark, monkeypatch):
    deepest, distances = [], graph._distances

    def watched(*args):
        found = distances(*args)
        deepest.append(max(x.depth for x in found.collect()))
        return found

    monkeypatch.setattr(graph, "_distances", watched)
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "src string, dst string")
    assert [(x.n, x.path) for x in graph.shortest_paths(e, "a", "c", 4, 5).collect()] == [(1, "a>b>c"), (2, "a>x>c")]
    assert deepest == [2]
    assert [tuple(x) for x in graph.shortest_paths(e, "a", "a", 4, 5).collect()] == [(1, "a")]
    monkeypatch.setattr(graph, "SMALL", 0)  # both sides parted
    assert {x.id: (x.depth, x.paths) for x in graph.shortest_path_counts(e, "a", 4).collect()} == {"a": (0, 1), "b": (1, 1), "x": (1, 1), "c": (2, 2), "d": (3, 2), "e": (4, 2)}


def test_expansion_and_edges_are_made_distinct_in_parts_of_bounded_rows(spark, monkeypatch):
    from factloom.operators import resolve
    from factloom.sources import tables

    monkeypatch.setattr(resolve, "ROWS", 20)
    monkeypatch.setattr(tables, "LINES", 300)
    monkeypatch.setattr(resolve, "side", lambda df, rows: df)  # neither side broadcast
    e = [(f"a{i}", f"b{i % 7}", "k") for i in range(300)] * 2 + [(f"b{i}", "c", "other") for i in range(7)] + [(None, "b1", "k")]
    anchors = spark.createDataFrame([("t", "x", f"b{i}") for i in range(7)] * 2 + [("u", "y", "a3"), ("u", "none", "a4")], "task string, intent string, id string")
    got = resolve.expanded(anchors, spark.createDataFrame(e, "src string, dst string, kind string"), {"x": [("k", "in")], "y": [("k", "out")]})
    assert sorted(tuple(r) for r in got.where("id IS NOT NULL").collect()) == sorted([("t", "k", f"a{i}", 1) for i in range(300)] + [("u", "k", "b3", 1)])
    assert got.where("id IS NULL").count() == 1
    assert max(got.rdd.glom().map(len).collect()) <= 40
    own = tables.edges(spark, FOLDER).where("kind = 'part-supplier'")
    assert own.rdd.getNumPartitions() > 20 and max(own.rdd.glom().map(len).collect()) <= 600


def test_ranked_texts_are_parted_by_their_number_and_split_once(spark, monkeypatch):
    from factloom.operators import search

    written, keep = [], search.kept

    def watched(df):
        written.append((df.rdd.getNumPartitions(), df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df)

    monkeypatch.setattr(search, "kept", watched)
    monkeypatch.setattr(search, "TEXTS", 10, raising=False)
    texts = [(i, "one two, two" if i % 2 else "three") for i in range(100)] + [(None, None), (None, " ,"), (7, ""), (7, "Two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    per, stat = search.ranked_texts(docs, spark.createDataFrame([("two",), ("one",), ("two",)], "word string"), "a-z")
    got = sorted((x.doc_id, x.n, sorted(map(tuple, x.hits))) for x in per.collect())
    assert got == sorted([(i, 3, [("one", 1), ("two", 2)]) if i % 2 else (i, 1, []) for i in range(100)] + [(7, 1, [("two", 1)])])
    assert tuple(stat.first()) == (101, (50 * 3 + 50 + 1) / 101)
    (parts, plan), = written
    assert parts > 10 and plan.count("split(lower(") == 1


def test_write_warnings_part_lines_by_their_objects_and_move_them_twice(spark, monkeypatch):
    from factloom.operators import findings
    from factloom.plans import findings as plan

    h = [(1, "BeforeWrite", "a", True, True, False), (1, "OnWrite", "b", True, True, None), (2, "OnWrite", "c", False, True, True), (2, "Posting", "d", True, True, False), (3, None, "e", True, True, False), (None, "OnWrite", "f", True, None, False), (4, "OnWrite", "g", None, None, None)]
    handlers = spark.createDataFrame(h, "object long, event string, name string, writes boolean, moves boolean, checks_load boolean")
    subscriptions = spark.createDataFrame([(1, "OnWrite", "s"), (1, "Posting", "s"), (2, "OnWrite", "s"), (2, "OnWrite", "r"), (2, "Posting", "s"), (2, "Posting", "r")], "object long, event string, name string")
    got = sorted(((x.rule, x.object) for x in findings.write_warnings(handlers, subscriptions).collect()), key=str)
    assert got == sorted([("SubscriptionOrder", 2), ("MovementsUnavailable", 1), ("WriteInsideHandler", 1), ("WriteInsideHandler", None), ("NoExchangeLoadCheck", 1), ("NoExchangeLoadCheck", None)], key=str)
    monkeypatch.setattr(plan, "LINES", 300, raising=False)
    df = plan.write_warnings(spark, FOLDER)
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert (shown.count("Exchange hashpartitioning"), shown.count("FileScan parquet")) == (2, 2)
    assert df.rdd.getNumPartitions() > 20
