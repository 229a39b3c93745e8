"""Inherited flags on trees and rings, reachability and coverage."""

import random

from factloom.operators import hierarchy


def test_flags_come_from_above(spark):
    r = random.Random(2)
    parent = {0: None, 500: 77_777, 501: 502, 502: 501} | {i: r.randrange(i) for i in range(1, 300)} | {600 + i: 599 + i if i else None for i in range(70)}
    own = {n: (r.random() < 0.05, r.random() < 0.03) for n in parent}
    own[502] = (True, False)

    def above(n, k):
        seen = set()
        while n is not None and n in parent and n not in seen:
            if own[n][k]:
                return True
            seen.add(n)
            n = parent[n]
        return False

    df = spark.createDataFrame([(n, p, *own[n]) for n, p in parent.items()], "node int, parent int, a boolean, b boolean")
    assert {x.node: (x.a, x.b) for x in hierarchy.inherited(df, ["a", "b"]).collect()} == {n: (above(n, 0), above(n, 1)) for n in parent}


def test_sections_parts_and_options(spark):
    make = spark.createDataFrame
    objects = make([(x,) for x in "abcdef"], "object string")
    subsystems = make([(1, None, True), (2, 1, True), (3, None, False), (4, 3, True), (5, 2, True)], "subsystem int, parent int, included boolean")
    contents = make([(5, "a"), (4, "b"), (4, "c"), (5, "c"), (2, "d"), (1, "e")], "subsystem int, object string")
    options = make([("subsystem", "2", "", False), ("object", "e", "", False), ("object", "d", "", False), ("object", "d", "", True), ("part", "a", "field x", False)], "kind string, target string, part string, enabled boolean")
    got = hierarchy.visibility(objects, contents.withColumn("subsystem", contents["subsystem"].cast("string")), subsystems.withColumn("subsystem", subsystems["subsystem"].cast("string")).withColumn("parent", subsystems["parent"].cast("string")), options, make([("a", True), ("b", False)], "object string, value boolean"))
    want = {("NotInAnySubsystem", "f", ""), ("NotInCommandInterface", "b", ""), ("SectionHidden", "a", ""), ("SectionHidden", "c", ""), ("SectionHidden", "d", ""), ("HiddenByFunctionalOption", "e", ""), ("PartHidden", "a", "field x")}
    assert {tuple(x) for x in got.collect()} == want | {("NoRoleGrantsRights", x, "") for x in "bcdef"}


def test_coverage_follows_calls_and_rings(spark):
    make = spark.createDataFrame
    calls = make([("h1", "a"), ("a", "b"), ("b", "a"), ("b", "reg"), ("h2", "c"), ("h3", "reg")], "src string, dst string")
    content = make([("p", "o1", False), ("p", "o2", False), ("p", "o3", True), ("q", "o1", False), ("p", "o4", True), ("p", "o5", False)], "plan string, object string, automatic boolean")
    handlers = make([("o1", "h1"), ("o2", "h2"), ("o3", "h3"), ("o4", "h2"), ("o1", "h2")], "object string, node string")
    got = hierarchy.exchange_coverage(content, handlers, calls, make([("p", "reg"), ("q", "none")], "plan string, node string"))
    assert {(x.plan, x.object): (x.handlers, x.reaching, x.status) for x in got.collect()} == {("p", "o1"): (2, 1, "manual"), ("p", "o2"): (1, 0, "uncovered"), ("p", "o3"): (1, 1, "twice"), ("q", "o1"): (2, 0, "uncovered"), ("p", "o4"): (1, 0, "automatic"), ("p", "o5"): (0, 0, "uncovered")}


def test_a_walk_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LEVEL", 0)
    monkeypatch.setattr(hierarchy, "SEEN", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 5), (3, 9)], "src long, dst long")
    goals = spark.createDataFrame([("a", 7), ("b", 12), ("b", 2)], "goal string, node long")
    got = {(x.goal, x.node) for x in hierarchy.reaching(edges, goals).collect()}
    everything = set(range(13))
    assert got == {("a", n) for n in everything} | {("b", n) for n in everything}
