"""Exact top-k inner-product search over KD-trees.

Vectors are dealt into shards by recursive median splits along the widest axis, found on a sample of
``SAMPLE`` vectors; a shard that holds more than its share, as of equal vectors, is divided by a hash
of the id. Every shard becomes one KD-tree with the tight bounding box of every node, built once and
stored with the shard's box and greatest norm. A query first searches the shard that promises
most; its kth score there is the bound with which it goes on to those other shards whose box and
norm still allow a better one. Within a tree it walks best-first by the greatest inner product
that a node's box and norm allow, and stops when that falls below its kth best score so far.
Queries come in blocks, so a cell holds one shard and one block, whatever the number of either.

Bounds are rounded up, so nothing is lost to floating point. Where vectors of many dimensions point
everywhere alike, no bound excludes much, and the search compares nearly all (see the README).

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
vectors of other lengths are padded with zeros; ties go to the smaller id; fewer candidates than
k give all; an empty vector scores 0; repeated rows with one id are candidates of each other's
ids, never of their own id, and among the queries the smallest vector of an id counts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

SHARD_ROWS = 8_192
SAMPLE = 16_384
#: Boxes of shards that a query block is compared with at once.
BOXES = 1_024
BLOCK_QUERIES = 2_048
LEAF = 128
OUT = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree over integer vectors, nodes in arrays: box, children or a run of points."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        self.low, self.high, self.kids, self.run = [], [], [], []
        self.order = np.arange(len(ids))
        self._x = x
        if len(ids):
            self._split(0, len(ids), leaf)
        self.ids, self.x = ids[self.order], x[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1)) if len(ids) else np.zeros(0)
        self.norm = np.array([norm[a:b].max() for a, b in self.run])

    def _split(self, a: int, b: int, leaf: int) -> int:
        own = self._x[self.order[a:b]]
        low, high = own.min(0), own.max(0)
        node = len(self.kids)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.run.append((a, b))
        if b - a > leaf and len(low) and (high > low).any():
            axis, mid = int(np.argmax(high - low)), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            self.kids[node] = (self._split(a, a + mid, leaf), self._split(a + mid, b, leaf))
        return node

    def search(self, me: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The best k (score, id) of the points, other than ``me``, that reach ``floor``."""
        if not len(self.ids):
            return []
        bound = bounds(self.low, self.high, self.norm, q[None, :])[:, 0]  # of every node at once
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= floor:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, b = self.run[node]
            score = self.x[a:b] @ q
            for i in np.flatnonzero(score >= floor).tolist():
                if self.ids[a + i] != me:
                    item = (score[i], -self.ids[a + i])
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(int(s), -int(i)) for s, i in best]


def bounds(low: np.ndarray, high: np.ndarray, norm: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Greatest inner product that each box and norm allow for each query, rounded up."""
    q = q.astype(np.float64)
    up = np.maximum(q, 0)
    box = high.astype(np.float64) @ up.T + low.astype(np.float64) @ (q - up).T
    most = np.minimum(box, norm[:, None] * np.sqrt((q**2).sum(1))[None, :])
    return most + np.abs(most) * 1e-9 + 1


def _splits(sample: np.ndarray, parts: int) -> list:
    """A tree of (axis, value, lower, upper) that cuts a sample into ``parts`` by medians; a leaf is None."""
    if parts < 2 or len(sample) < 2:
        return None
    spread = sample.max(0) - sample.min(0) if sample.shape[1] else np.zeros(1)
    axis = int(np.argmax(spread))
    if not spread[axis]:
        return None
    value = int(np.median(sample[:, axis]))
    lower = sample[:, axis] <= value
    if lower.all():
        value -= 1
        lower = sample[:, axis] <= value
    return (axis, value, _splits(sample[lower], (parts + 1) // 2), _splits(sample[~lower], parts // 2))


def _placed(x: np.ndarray, tree) -> np.ndarray:
    """Number of the leaf of each vector."""
    out, leaves = np.zeros(len(x), np.int64), 0
    stack = [(tree, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if node is None:
            out[at] = leaves
            leaves += 1
        else:
            lower = x[at, node[0]] <= node[1] if len(at) else np.zeros(0, bool)
            stack += [(node[2], at[lower]), (node[3], at[~lower])]
    return out


def quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``, the components as floor(256 x); unusable vectors are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").where(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    """Rows padded with zeros; floating point as long as it is exact for their products."""
    out = np.zeros((len(v), dim), np.int64)
    for i, row in enumerate(v):
        out[i, : len(row)] = row
    return out.astype(np.float64) if not out.size or float(np.abs(out).max()) ** 2 * max(dim, 1) < 2**52 else out


def _cell(k: int, dim: int):
    """Search one shard for one block of queries."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        tree, q = pickle.loads(left["tree"].iloc[0]), _matrix(right["q"], dim)
        if tree.x.dtype != q.dtype:
            tree.x, q = tree.x.astype(np.int64), q.astype(np.int64)
        floors = [f if f == f and f is not None else -np.inf for f in right["floor"].tolist()]
        rows = [(i, j, s) for n, (i, f) in enumerate(zip(right["query_id"].tolist(), floors)) for s, j in tree.search(i, q[n], k, f)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def index(vectors: DataFrame, dim: int) -> DataFrame:
    """One row for each shard: ``shard, low, high, norm, tree``."""
    parts = max(1, -(-vectors.count() // SHARD_ROWS))
    rate = min(1.0, SAMPLE / (parts * SHARD_ROWS))
    u = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = vectors.where(u < rate).orderBy(F.xxhash64("vec_id", F.lit("order"))).limit(2 * SAMPLE).select("v").toPandas() if parts > 1 else None
    splits = _splits(_matrix(drawn["v"], dim), parts) if drawn is not None and len(drawn) else None

    @F.pandas_udf("long")
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(_placed(_matrix(v, dim), splits), dtype="int64")

    dealt = saved(vectors.withColumn("leaf", leaf("v")))
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / (2.0 * SHARD_ROWS)).cast("int").alias("parts"))  # one row a shard
    dealt = dealt.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], dim))
        return pd.DataFrame({"low": [tree.low[0].astype(np.int64).tolist()], "high": [tree.high[0].astype(np.int64).tolist()], "norm": [float(tree.norm[0])], "tree": [pickle.dumps(tree)]})

    trees = dealt.select("leaf", "part", "vec_id", "v").groupBy("leaf", "part").applyInPandas(build, "low array<long>, high array<long>, norm double, tree binary")
    return saved(trees.select(F.monotonically_increasing_id().alias("shard"), "*"))


def _routes(asked: DataFrame, boxes: DataFrame, n_boxes: int, dim: int, best: bool) -> DataFrame:
    """``query_id``, ``shard`` of the shards that may hold something at or above a query's floor.

    With ``best``, only the one that promises most.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "shard": [], "bound": []}).astype({"query_id": "int64", "shard": "int64", "bound": "float64"})
        most = bounds(np.array(left["low"].tolist()).reshape(len(left), dim), np.array(left["high"].tolist()).reshape(len(left), dim), left["norm"].to_numpy(), _matrix(right["q"], dim))
        floor = right["floor"].fillna(-np.inf).to_numpy()
        i, j = np.nonzero(most >= floor[None, :]) if not best else (most.argmax(0), np.arange(len(right)))
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[j], "shard": left["shard"].to_numpy()[i], "bound": most[i, j]})

    blocks = max(1, -(-n_boxes // BOXES))
    cells = boxes.withColumn("cell", F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int")).withColumn("block", F.explode(F.array_distinct(F.lit(list(range(_blocks(asked)))))))
    each = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("deal")), F.lit(_blocks(asked))).cast("int")).withColumn("cell", F.explode(F.lit(list(range(blocks)))))
    found = cells.groupBy("cell", "block").cogroup(each.groupBy("cell", "block")).applyInPandas(run, "query_id long, shard long, bound double")
    if best:
        found = found.groupBy("query_id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    return found.select("query_id", "shard")


def _blocks(asked: DataFrame) -> int:
    return max(1, -(-asked.count() // BLOCK_QUERIES))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of ``vectors`` for each of ``queries``.

    Both have ``vec_id`` and ``v`` (:func:`quantized`); repeated ids among the queries count once.
    """
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    asked_dim = queries.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(dim, asked_dim)
    trees = index(vectors, dim)
    boxes = trees.drop("tree")
    n = boxes.count()
    q = saved(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")).withColumn("floor", F.lit(None).cast("double")))

    def sweep(routes: DataFrame) -> DataFrame:
        # a shard that many queries visit is read once for each block of them
        blocks = routes.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
        cells = trees.join(F.broadcast(blocks), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # one row a shard
        asked = routes.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("deal")), F.col("blocks")).cast("int"))
        return cells.select("shard", "block", "tree").groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_cell(k, dim), OUT)

    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    home = saved(_routes(q, boxes, n, dim, True))
    first = saved(sweep(home.join(q, "query_id")))
    if n == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    kth = _best(first, k).groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n")).where(f"n = {k}").drop("n")
    asked = saved(q.drop("floor").join(kth, "query_id", "left"))
    others = saved(_routes(asked, boxes, n, dim, False).join(home, ["query_id", "shard"], "left_anti"))
    rest = sweep(others.join(asked, "query_id"))
    return _best(first.union(rest), k).select("query_id", "rank", "vec_id", "score")
