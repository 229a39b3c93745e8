"""Joins whose sides Spark would size too low, or that were counted as too many to broadcast."""

import os
import sys

import pytest

pytest.importorskip("factloom.llm")

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from factloom.llm import common, simhash, verify  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_broadcast_nothing_after_the_inline(spark):
    fps = common.saved(spark.createDataFrame([(0,), (1,), (7,), (1 << 40,), (-1,)], "fp long"))
    got = simhash.links(fps, 2)
    assert "BroadcastExchange" not in plan(got)
    assert {(x.a, x.b) for x in got.collect()} == {(0, 1), (1, 7), (0, 1 << 40), (1, 1 << 40)}


def test_tables_counted_as_many_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(verify, "BROADCAST_IDS", 0)
    rows = common.saved(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id long, x string"))
    ids = common.saved(spark.createDataFrame([(2,), (3,)], "id long"))
    for got, want in ((common.join_ids(rows, ids, "id", "left_semi"), "bc"), (common.join_ids(rows, ids, "id", "left_anti"), "ad"), (verify.with_few(rows, ids, "id", "inner"), "bc")):
        assert "BroadcastExchange" not in plan(got)
        assert sorted(x.x for x in got.collect()) == list(want)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long")
    assert {(x.id, x.component) for x in common.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
