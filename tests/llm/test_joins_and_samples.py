"""N-gram join, importance resampling and whitening against brute force, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("factloom.llm")

from factloom.llm import ngrams, queries, resample, whiten  # noqa: E402

from .test_operators import components_of  # noqa: E402

SCHEMA = "doc_id long, text string, n_shingles int, component_id string, weight int"
low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_join(spark, rows, **options):
    """The join's rows equal those of all pairs."""
    sets = [n_grams(t) for _, t in rows]
    at = range(len(rows))
    pairs = [(a, b) for a in at for b in at if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = components_of(at, pairs)
    ids = {}
    for i in at:
        ids.setdefault(group.get(i, i), []).append(rows[i][0])
    least = {g: min((x for x in own if x is not None), default=None) for g, own in ids.items()}
    want = sorted(((rows[i][0], len(sets[i]), least[group.get(i, i)]) for i in at), key=str)
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    got = ngrams.join(docs, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    return len(pairs)


def test_join_of_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "É a b c d"), (7, "é a b c d"), (8, "a b c d e f g h"), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "lone text of no other"), (10, long), (11, long + " x"), (12, "a b c d e " * 50), (13, "1 2 3 4 5 6 7 8"), (14, "1 2 3 4 5 6 7 8 9"), (14, "x y z"), (14, "1 2 3 4 5 6 7 8 9")]
    assert check_join(spark, rows) > 5
    assert ngrams.join(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cell, sparse", [(2_048, 4), (8, 0)])
def test_join_of_random_edits(spark, monkeypatch, cell, sparse):
    """Chains, stars (an original whose copies are not alike), a common passage and lone texts."""
    monkeypatch.setattr(ngrams, "SPARSE", sparse)
    r = random.Random(5)
    rows = []
    for _ in range(25):
        base = [f"v{r.randrange(10**6)}" for _ in range(r.randint(30, 120))]
        for n in range(4):
            w = list(base)
            for _ in range(n):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(w[: r.choice((len(w), len(w), len(w) - 2))]))
    star = [f"s{i}" for i in range(100)]
    rows.append(" ".join(star))
    for k in range(40):
        rows.append(" ".join(w if i not in (k + 10, k + 50) else f"{w}x{k}" for i, w in enumerate(star)))
    chain = [f"c{i}" for i in range(160)]
    rows += [" ".join(chain[k : k + 60]) for k in range(0, 90, 5)]
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randint(2, 30))) for _ in range(40)]
    r.shuffle(rows)
    assert check_join(spark, list(enumerate(rows)), cell=cell) >= 80


def crc(run):
    return zlib.crc32(run.encode()) % 10_000


def plain_sample(docs, target, orders, percent, least):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))

    def runs(w):
        return [crc(" ".join(w[i : i + k])) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(runs(words(x)))
    for x in target:
        t.update(runs(words(x)))
    total = [sum(s.values()) + 10_000, sum(t.values()) + 10_000]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1])))
    out = []
    for i, (doc_id, x) in enumerate(docs):
        w = words(x)
        weight = sum(map(gain, runs(w)))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(order[: len(order) * percent // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_equals_brute_force(spark, orders):
    r = random.Random(8)
    make = lambda n: " ".join(r.choice(("alpha", "Beta", "gämma", "漢字", "x1", "it's", "\U0001d400b")) + r.choice((",", "", " ")) for _ in range(n))
    docs = [(i, make(r.randint(1, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "!?"), (None, make(40)), (None, make(40)), (203, make(20_000))] + [(204, "same row " * 15)] * 3
    target = [make(12), None, "", "alpha alpha x1"]
    frame = spark.createDataFrame([(*x, 1, "c", 2) for x in docs], SCHEMA).repartition(4)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(frame, bench, orders=orders)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_sample(docs, target, orders, 10, 20), key=str)
    assert resample.resample(frame.limit(0), bench).count() == 0
    assert sum(x["rank"] is not None for x in resample.resample(frame, bench.limit(0)).collect()) == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))) >= 20 for _, t in docs) // 10


def test_ranks_go_on_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5_000).selectExpr("id", "id % 7 AS score")
        got = resample.ranked(rows, [rows["score"].desc(), rows["id"]]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((-(i % 7), i) for i in range(5_000)))
    assert [x.id for x in sorted(got, key=lambda x: x["rank"])] == [i for _, i in want] and sorted(x["rank"] for x in got) == list(range(1, 5_001))


def check_whitened(vectors, got, k=4):
    """Against the eigenvectors of the covariance of the distinct vectors."""
    real = [(i, v) for i, v in vectors if v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    x = {i: tuple(math.floor(float(np.float32(c)) * 256) for c in v) for i, v in real}
    fit = np.array(sorted(set(x.values())), float)
    n, mean = len(fit), fit.mean(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    sums = [sum(int(c) for c in col) for col in zip(*sorted(set(x.values())))]
    assert len(got) == len(real) * k
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        z = np.array([(np.array(x[r.vec_id]) - mean) @ axes[:, c] / math.sqrt(values[c]) for r in own])
        w = np.array([r.whitened for r in own])
        assert min(np.abs(z - w).max(), np.abs(z + w).max()) < 1e-7
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-9 and r.n == n and r.identity_error < 1e-9 for r in own)
        assert all(r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums)) for r in own)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [float(v) for v in rng.normal(size=12).astype(np.float32)]) for i in range(400)]
    steep = [(i, [float(v) for v in (rng.normal(size=40) * 0.5 ** np.arange(40) + 3).astype(np.float32)]) for i in range(500)]
    for rows in (flat, steep):
        odd = [(9_000 + i, rows[0][1]) for i in range(300)] + [(9_900, None), (9_901, [1.0, None] + [0.0] * (len(rows[0][1]) - 2)), (9_902, [float("inf")] * len(rows[0][1])), (9_903, [float("nan")] * len(rows[0][1]))]
        frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, component int")
        got = whiten.whiten(frame)
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        check_whitened(rows + odd, got.collect())


def test_the_range_finder_stops_early_only_if_it_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in (rng.normal(size=60) * np.append([40, 20, 10, 5], np.full(56, 0.05))).astype(np.float32)]) for i in range(600)]
    fit = whiten.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select("x").distinct()
    x = np.array([r.x for r in fit.collect()], float)
    axes, values, how = whiten.principal(fit, 60, x.mean(0), len(x), 4)
    assert not how["full"] and np.allclose(values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4], rtol=1e-12)
    round_ = [(i, [float(v) for v in rng.normal(size=60).astype(np.float32)]) for i in range(300)]
    fit = whiten.quantized(spark.createDataFrame(round_, "vec_id long, embedding array<float>")).select("x").distinct()
    x = np.array([r.x for r in fit.collect()], float)
    axes, values, how = whiten.principal(fit, 60, x.mean(0), len(x), 4)
    assert how["full"] and np.allclose(values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4], rtol=1e-12)


def test_whitening_of_few_and_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, n int"
    assert whiten.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).count() == 0
    one = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], schema)).collect()
    assert len(one) == 4 and all(x.n == 1 and x.deviation == 0 and x.whitened is None and x.explained == 0 and x.identity_error == 0 for x in one)
    mixed = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [0.0, 5.0], 1), (3, [1.0], 1), (4, [3e38, 1.0], 1)], schema)).collect()
    assert {x.vec_id for x in mixed} == {1, 2, 4} and {x.deviation for x in mixed} == {None}


def test_registered_queries_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(3)]
    save = lambda df, name: df.write.parquet(f"{tmp_path}/{name}.parquet")
    save(spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA), "documents")
    save(spark.createDataFrame([(1, "a b c"), (2, None)], "item_id long, text string"), "benchmark")
    got = queries.op12_resampling(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_sample(rows, ["a b c", None], 1, 10, 20), key=str)
    joined = {x.doc_id: x for x in queries.op11_ngram_join(spark, str(tmp_path)).collect()}
    assert len(joined) == len(rows) and all(joined[100 + i].component_id == joined[3].component_id <= 3 for i in range(3))
