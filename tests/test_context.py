"""Walks and expansions of many tasks at once."""

import random

from factloom.operators import context, search


def plain_walk(edges, root, depth, node_cap, fan_cap):
    """One task's walk by hand: visited ids with depth in order, and whether it was cut."""
    seen, level, cut = {root: 0}, [root], False
    for k in range(1, depth + 1):
        following = []
        for src in level:
            own = sorted((o, d) for s, d, o in edges if s == src)
            cut |= len(own) > fan_cap
            for o, d in own[:fan_cap]:
                if d not in seen and d not in following:
                    following.append(d)
        room = node_cap - len(seen)
        cut |= len(following) > room
        level = following[: max(0, room)]
        seen |= dict.fromkeys(level, k)
        if not level:
            break
    return seen, cut


def test_walks_of_many_tasks_keep_their_own_caps(spark):
    r = random.Random(6)
    edges = [(f"n{a}", f"n{b}", i) for i, (a, b) in enumerate({(r.randrange(30), r.randrange(30)) for _ in range(160)})]
    df = spark.createDataFrame(edges, "src string, dst string, order int")
    starts = spark.createDataFrame([(t, f"n{t % 30}") for t in range(40)], "task int, id string")
    for node_cap, fan_cap in ((40, 40), (6, 3)):
        seen, cut = context.walks(df, starts, 3, node_cap, fan_cap)
        got: dict = {}
        for x in seen.collect():
            got.setdefault(x.task, {})[x.id] = x.depth
        want = {t: plain_walk(edges, f"n{t % 30}", 3, node_cap, fan_cap) for t in range(40)}
        assert got == {t: w[0] for t, w in want.items()}
        assert {x.task for x in cut.collect()} == {t for t, w in want.items() if w[1]}


def test_statuses_and_verdicts(spark):
    tasks = spark.createDataFrame([(1, "bugfix"), (2, "bugfix"), (3, "register"), (4, "anything")], "task int, intent string")
    rows = [(1, "definition", True, False), (1, "callers", True, False), (2, "definition", True, True), (2, "callers", True, False), (2, "callees", True, False), (3, "writes_movements", True, False), (3, "writes_movements", False, False), (4, "definition", False, False)]
    packed = spark.createDataFrame(rows, "task int, category string, admitted boolean, linked boolean")
    tried = spark.createDataFrame([(1, "callees", True), (3, "owning_symbols", False)], "task int, category string, declared boolean")
    covered, told = context.sufficiency(tasks, packed, tried)
    assert {(x.task, x.category): x.status for x in covered.collect()} == {
        (1, "definition"): "complete_inline", (1, "callers"): "complete_inline", (1, "callees"): "complete_empty",
        (2, "definition"): "complete_via_resource", (2, "callers"): "complete_inline", (2, "callees"): "complete_inline",
        (3, "writes_movements"): "partial", (3, "owning_symbols"): "missing",
        (4, "definition"): "missing", (4, "callers"): "missing", (4, "callees"): "missing",
    }
    assert {x.task: (x.sufficiency, x.lacking) for x in told.collect()} == {1: ("sufficient_inline", ""), 2: ("requires_resource_fetch", ""), 3: ("insufficient", "writes_movements,owning_symbols"), 4: ("insufficient", "definition,callers,callees")}


def test_every_intent_finds_its_categories(spark):
    relations = [(s.relation, "a" if not s.after else s.after, f"{i}.{s.category}" if not any(x.after == s.category for x in steps) else s.category, 0.9) if s.direction == "out" else (s.relation, f"{i}.{s.category}", "a", 0.9) for i, steps in context.STRATEGIES.items() for s in steps]
    df = spark.createDataFrame(relations, "relation string, src string, dst string, confidence double").distinct()
    anchors = spark.createDataFrame([(k, i, "a", 1.0) for k, i in enumerate(context.STRATEGIES)], "task int, intent string, id string, strength double")
    found, tried = context.expanded(anchors, df)
    got = {(x.intent, x.category) for x in found.collect()}
    assert got == {(i, s.category) for i, steps in context.STRATEGIES.items() for s in steps}
    assert {(x.task, x.category) for x in tried.collect()} == {(k, s.category) for k, (i, steps) in enumerate(context.STRATEGIES.items()) for s in steps}


def plain_climb(start, sure, up, owners, node_budget, caller_cap, hub, free):
    """One access by hand: its owners with the surest chain, and whether the climb was cut."""
    best, frontier, hits, cut, level = {start: sure}, {start: sure}, {}, False, 0
    while frontier:
        level += 1
        for x, c in frontier.items():
            if x in owners:
                hits[owners[x]] = max(hits.get(owners[x], 0), c)
        go = {x: c for x, c in frontier.items() if x not in owners}
        if len(best) >= node_budget:
            return hits, cut or bool(go)
        new = {}
        for x, c in go.items():
            callers = sorted(up.get(x, {}).items())
            cut |= len(callers) > caller_cap
            for y, s in callers[:caller_cap]:
                new[y] = max(new.get(y, 0), min(c, s) * (0.7 if len(callers) > hub else 1) * (0.9 if level > free else 1))
        frontier = {y: c for y, c in new.items() if c > best.get(y, 0)}
        best |= frontier
    return hits, cut


def test_attribution_says_where_it_was_cut(spark):
    from factloom.operators import graph

    r = random.Random(17)
    calls = {(r.randrange(40), r.randrange(40)): r.choice((0.6, 0.8, 0.95)) for _ in range(110)}
    owners = {x: f"o{x % 5}" for x in range(0, 40, 6)}
    up: dict = {}
    for (a, b), s in calls.items():
        up.setdefault(b, {})[a] = s
    starts = {f"a{i}": (r.randrange(40), r.choice((0.7, 0.9))) for i in range(30)}
    make = spark.createDataFrame
    for budget, cap in ((500, 200), (8, 3)):
        got = graph.traced_attribution(make([(k, *v) for k, v in starts.items()], "access string, symbol int, confidence double"), make([(a, b, s) for (a, b), s in calls.items()], "caller int, callee int, confidence double"), make(list(owners.items()), "symbol int, owner string"), budget, cap, 3)
        want = {k: plain_climb(*v, up, owners, budget, cap, 3, 2) for k, v in starts.items()}
        assert {(x.access, x.owner): (round(x.confidence, 9), x.truncated) for x in got.collect()} == {(k, o): (round(c, 9), w[1]) for k, w in want.items() for o, c in w[0].items()}


def test_a_trace_writes_no_step_and_nothing_beyond_its_last_level(spark, monkeypatch):
    from factloom.operators import graph

    written, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: written.append(df.columns) or kept(df))
    calls = spark.createDataFrame([(2, 1, 0.9), (3, 2, 0.8), (4, 3, 0.7)], "caller int, callee int, confidence double")
    owners = spark.createDataFrame([(3, "o")], "symbol int, owner string")
    found = graph.traced_attribution(spark.createDataFrame([("a", 1, 1.0)], "access string, symbol int, confidence double"), calls, owners, most_steps=3)
    assert [tuple(x) for x in found.collect()] == [("a", "o", 0.8, 2, False, False)]
    assert not any("access" in c and "caller" in c for c in written)
    assert sum("penalised" in c and "owner" not in c for c in written) == 3


def test_attribution_ends_at_owners_and_drops_other_last_callers(spark, monkeypatch):
    from factloom.operators import graph

    written, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: written.append(df) or kept(df))
    calls = spark.createDataFrame([(2, 1, 0.9), (3, 2, 0.8), (4, 2, 0.7), (5, 4, 0.6)], "caller int, callee int, confidence double")
    owners = spark.createDataFrame([(3, "o"), (4, "p"), (5, "q"), (1, None)], "symbol int, owner string")
    accesses = spark.createDataFrame([(1, "r", "write", 1.0)], "symbol int, register string, mode string, confidence double")
    assert sorted(tuple(x) for x in graph.attribution(accesses, calls, owners, depth=2).collect()) == [("o", "r", "write", 0.8), ("p", "r", "write", 0.7)]
    # the callers, the accesses and one level between: the last one is not written
    assert len(written) == 3


def test_blocks_that_admit_nothing_are_not_folded(spark):
    r = random.Random(3)
    rows = [(t, "ab"[r.randrange(2)], f"i{k:03}", r.choice([3, 5, 8, 40]) if k < 60 or t % 2 else 90, r.random()) for t in range(6) for k in range(20 * t + 1)]
    # one candidate of a late block still fits
    rows += [(9, "a", f"i{k:03}", 1 if k == 77 else 30, 1.0 - k / 100) for k in range(90)]
    rows += [(None, "a", f"i{k:03}", 7, 1.0 - k / 100) for k in range(35)]
    df = spark.createDataFrame(rows, "task int, category string, id string, cost long, score double")
    folds = []
    original = search.kept
    try:
        search.kept = lambda x: folds.append(x) or original(x)
        got = {(x.task, x.id): (x.used, x.admitted) for x in search.packed_context(df, ["b"], 100, block=10).collect()}
    finally:
        search.kept = original
    want = {}
    for t in {x[0] for x in rows}:
        used = 0
        for _, _, i, cost, _ in sorted((x for x in rows if x[0] == t), key=lambda x: (x[1] != "b", -x[4], x[2])):
            ok = used + cost <= 100
            used += cost * ok
            want[t, i] = (used, ok)
    assert got == want
    assert want[9, "i077"][1] and len(folds) < 11  # of eleven blocks


def test_only_what_leads_on_from_the_nodes_is_asked_for(spark):
    relations = [("calls", f"s{k}", f"s{(k * 7 + n) % 40}", 0.5 + n / 10) for k in range(40) for n in range(3)] + [("body", f"s{k}", f"b{k}", 1.0) for k in range(40)] + [("handlers", "f", "s5", 1.0), ("same_name", "s1", "s2", 0.7)]
    df = spark.createDataFrame(relations, "relation string, src string, dst string, confidence double")
    anchors = spark.createDataFrame([(1, "bugfix", "s1", 1.0), (2, "form", "f", 1.0), (3, "signature-change", "s1", 0.6)], "task int, intent string, id string, strength double")
    asked = set()

    def leads(direction, wanted):
        asked.update((direction, x.relation, x.node) for x in wanted.collect())
        return context._leads(df, direction, wanted).join(wanted, ["relation", "node"], "left_semi")

    whole, some = (context.expanded(anchors, x) for x in (df, leads))
    for a, b in zip(whole, some):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert ("in", "calls", "s1") in asked and ("out", "body", "s5") in asked and ("out", "calls", "s5") in asked
    # the first steps of two intents, the walk of one, and what the form's handler does
    assert {n for _, r, n in asked if r == "body"} == {"s1", "s5"} and {n for w, r, n in asked if w == "in"} == {"s1"}
