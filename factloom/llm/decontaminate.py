"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``SEED`` words meet: runs are hashed
(Karp-Rabin over word hashes) on both sides and joined. A map of ``2**FILTER_BITS`` bits, set for
the hashes of the benchmark's runs, goes to the tasks that read documents, so that only runs that
can join leave them; its size is fixed, and a fuller map only lets more through. For every pair
that has enough runs in common to reach the coverage, the longest matches that don't overlap
earlier tiles are marked again and again, longest first, until none of ``SEED`` words is left. The
tiles' share of the item's words is its coverage, so a passage whose sentences were put in another
order still counts.

Neither table passes through the driver or one task: the map is merged in Spark and is all that
reaches the driver, runs and pairs are joined by Spark, and every pair is tiled by itself.

Words are lower-cased runs of letters, digits and underscores. Defined cases: null or empty
texts have no words and match nothing; an item of fewer than ``SEED`` words must occur as a
whole; an item that occurs twice in the benchmark is two items; a null doc_id or item_id is kept
as it is; repeated rows are scanned alike; an empty table on either side gives no overlaps; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, released, saved
from .words import hashes, mix

SEED = 5
COVERAGE = 0.5
#: The map of seed hashes has this many bits as a power of two: 2 MB.
FILTER_BITS = 24
#: Pairs of equal runs of a document and an item that are written out; more are searched by length.
PAIRED = 1 << 20
#: Characters of texts whose words are hashed at once.
PART = 1 << 18
WORDS = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(sys.maxunicode + 1, bool)
for _a in range(0, len(_WORD), 1 << 12):
    for _m in WORDS.finditer("".join(map(chr, range(_a, min(_a + (1 << 12), len(_WORD)))))):
        _WORD[_a + _m.start() : _a + _m.end()] = True


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order."""
    group: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        group.append((t or "").lower())
        size += len(group[-1])
        if size >= PART or i == len(texts) - 1:
            cps = np.frombuffer(("\n".join(group) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            edge = np.flatnonzero(np.diff(_WORD[cps], prepend=False))
            start, end = edge[::2], edge[1::2]
            h = mix(hashes(cps, start, end) + (end - start).astype(np.uint64))
            bounds = np.searchsorted(start, np.cumsum([len(g) + 1 for g in group]))
            yield from np.split(h, bounds[:-1])
            group, size = [], 0


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``n`` values."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MUL + ids[i : len(ids) - n + 1 + i]
    return out


def _seeds(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, which differ for other ``n``."""
    return mix(rolling(ids, n) + np.uint64(n))


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (position in doc, position in item, length), longest matches first.

    Matches that start in the same run are extended together; a tile's words are not used again
    on either side. Among equal lengths the earlier in the item, then in the document, wins.
    """
    ours, theirs = rolling(doc, least), rolling(item, least)
    order = np.argsort(ours, kind="stable")
    low, high = (np.searchsorted(ours[order], theirs, side) for side in ("left", "right"))
    count = high - low
    if count.sum() > PAIRED:  # texts that repeat themselves
        return _tiles_by_length(doc, item, least)
    j = np.repeat(np.arange(len(theirs)), count)
    p = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(j))]
    # a match runs along a diagonal: find the maximal runs once, then cut them as tiles are marked
    along = np.lexsort((j, p - j))
    j, p = j[along], p[along]
    first = np.flatnonzero(np.append(True, (np.diff(p - j) != 0) | (np.diff(j) != 1))[: len(j)])
    length = np.diff(np.append(first, len(j))) + least - 1
    heap = list(zip((-length).tolist(), j[first].tolist(), p[first].tolist()))
    heapq.heapify(heap)
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    while heap:
        n, j0, p0 = heapq.heappop(heap)
        n = -n
        ok = free_doc[p0 : p0 + n] & free_item[j0 : j0 + n]
        if ok.all():
            if (doc[p0 : p0 + n] == item[j0 : j0 + n]).all():
                free_doc[p0 : p0 + n] = False
                free_item[j0 : j0 + n] = False
                out.append((p0, j0, n))
            continue
        edge = np.flatnonzero(np.diff(ok, prepend=False, append=False))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (-(b - a), j0 + a, p0 + a))
    return out


def _tiles_by_length(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """:func:`tiles` in memory that grows with the two texts, not with what they share.

    The greatest length at which free runs of both agree is found by halving, its matches are marked
    in order, and the search goes on below it.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def runs(ids: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the free runs of ``n`` values, by doubling."""
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h, width = np.zeros(len(ids) - n + 1, np.uint64), 0
        block, size = mix(ids), 1
        while n >> width:
            if n >> width & 1:
                at = n & ((1 << width) - 1)  # shorter blocks stand before
                h = mix(h * _MUL + block[at : at + len(h)])
            block = mix(block[: len(block) - size] * _MUL + block[size:]) if len(block) > size else block[:0]
            size *= 2
            width += 1
        used = np.cumsum(np.append(0, ~free))
        at = np.flatnonzero(used[n:] == used[:-n])
        return at, h[at]

    def shared(n: int) -> bool:
        return bool(np.isin(runs(item, free_item, n)[1], runs(doc, free_doc, n)[1]).any())

    high = min(len(doc), len(item))
    while high >= least:
        low = least - 1  # the longest match has at least ``low`` and at most ``high`` words
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        if high < least:
            break
        (p, h), (j, g) = runs(doc, free_doc, high), runs(item, free_item, high)
        order = np.argsort(h, kind="stable")
        p, h = p[order], h[order]
        begin, end = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
        turn: dict[int, int] = {}  # the first place of a run that may still be free
        for i, a, b in zip(j.tolist(), begin.tolist(), end.tolist()):
            if a == b or not free_item[i : i + high].all():
                continue
            k = turn.get(a, a)
            while k < b and not free_doc[p[k] : p[k] + high].all():
                k += 1
            turn[a] = k
            if k < b:
                at = int(p[k])
                free_doc[at : at + high] = False
                free_item[i : i + high] = False
                out.append((at, i, high))
        high -= 1
    return out


def benchmark_seeds(items: DataFrame, seed: int) -> DataFrame:
    """``item`` (a number), ``words``, ``least`` and the ``hash`` of each run of ``least`` words, as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, ids in zip(batch["item"].to_pylist(), word_hashes(batch["text"].to_pylist())):
                least = min(seed, len(ids))
                h = _seeds(ids, least).view(np.int64) if least else np.zeros(0, np.int64)
                same = np.ones(len(h), np.int64)
                yield pa.record_batch({"item": item * same, "words": len(ids) * same, "least": least * same, "hash": h})

    return items.select("item", "text").mapInArrow(released(run), "item long, words long, least long, hash long")


def _map(seeds: DataFrame) -> np.ndarray:
    """Bits of the hashes of all seeds; merged in Spark, so the driver gets it once, whatever the input."""
    at = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = seeds.select(F.shiftright(at, 6).alias("k"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 AS INT))").alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for x in bits.groupBy("k").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[x["k"]] = x["b"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def pairs(rows: DataFrame, seeds: DataFrame, coverage: float) -> DataFrame:
    """``doc_id``, ``h`` and ``item`` of the pairs that can reach the coverage.

    Tiles have ``least`` words or more, so an item of n words that is covered to n * coverage words
    has that many / ``least`` different runs or more in the document.
    """
    lengths = [r["least"] for r in seeds.select("least").distinct().collect()]  # at most ``SEED`` numbers
    shared = rows.sparkSession.sparkContext.broadcast(_map(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - FILTER_BITS)
        for batch in batches:
            at, found = [], []
            for i, ids in enumerate(word_hashes(batch["text"].to_pylist())):
                for n in lengths:
                    h = _seeds(ids, n)
                    hit = np.unique(h[shared.value[h >> shift]]).view(np.int64)
                    if len(hit):
                        at.append(np.full(len(hit), i))
                        found.append(hit)
            if at:
                own = pa.array(np.concatenate(at))
                yield pa.record_batch([batch["doc_id"].take(own), batch["h"].take(own), pa.array(np.concatenate(found))], names=["doc_id", "h", "hash"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    hits = rows.select("doc_id", "h", "text").mapInArrow(released(run), f"doc_id {kind}, h long, hash long")
    grouped = saved(seeds.groupBy("hash", "item").agg(F.count("*").alias("n"), F.first("words").alias("words"), F.first("least").alias("least")))
    few = grouped.count() <= BROADCAST_IDS // 2
    met = hits.join(F.broadcast(grouped) if few else grouped, "hash").groupBy("doc_id", "h", "item").agg(F.sum("n").alias("n"), F.first("words").alias("words"), F.first("least").alias("least"))
    return met.where(F.col("n") * F.col("least") >= F.col("words") * coverage - 1e-9).select("doc_id", "h", "item")


def _numbered(benchmark: DataFrame) -> DataFrame:
    return saved(benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("item")))


def _tiled(docs: DataFrame, benchmark: DataFrame, seed: int, coverage: float) -> DataFrame:
    """``doc_id, h, item_id, coverage, tiles, longest`` of the covered pairs, one row for equal documents."""
    items = _numbered(benchmark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    met = saved(pairs(rows, saved(benchmark_seeds(items, seed)), coverage))
    ids = met.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    few = met.count() <= BROADCAST_IDS // 2
    texts = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")), "left_semi")
    texts = saved(texts.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("text").alias("_text")).dropDuplicates(["_id", "_h"]))
    both = met.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h"))).join(items, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item in zip(word_hashes(batch["_text"].to_pylist()), word_hashes(batch["text"].to_pylist())):
                marked = tiles(doc, item, min(seed, len(item)))
                out.append((sum(t[2] for t in marked) / len(item), len(marked), max((t[2] for t in marked), default=0)))
            kept = [batch[c] for c in ("doc_id", "h", "item_id")]
            yield pa.record_batch([*kept, *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.int32())))], names=["doc_id", "h", "item_id", "coverage", "tiles", "longest"])

    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    found = both.select("doc_id", "h", "item_id", "_text", "text").mapInArrow(released(run), f"doc_id {kinds[0]}, h long, item_id {kinds[1]}, coverage double, tiles int, longest int")
    return saved(found.where(F.col("coverage") >= coverage))


def overlaps(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, coverage, tiles, longest."""
    found = _tiled(docs, benchmark, seed, coverage)
    few = found.count() <= BROADCAST_IDS // 2
    hit = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "item_id", "coverage", "tiles", "longest")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return rows.join(F.broadcast(hit) if few else hit, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h"))).select("doc_id", "item_id", "coverage", "tiles", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item covers up to ``coverage``, in all their columns."""
    found = _tiled(docs, benchmark, seed, coverage).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    few = found.count() <= BROADCAST_IDS // 2
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"].eqNullSafe(F.col("_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_h")), "left_anti")
