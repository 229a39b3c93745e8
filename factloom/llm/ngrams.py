"""Exact Jaccard join of documents over their n-grams.

A document is the set of its word n-grams; documents of equal sets form a class first, so copies
are never paired. N-grams are ordered rare first (counted over all documents in ``2**RARITY_BITS``
buckets; any order common to all keeps the join exact) and a class is entered under the n-grams
of its prefix: two classes that match share one among the first ``n - ceil(s * n) + 1`` of the longer
and the first ``n - ceil(2 * s / (1 + s) * n) + 1`` of the shorter. Pairs under an n-gram must pass the
length filter and the positional filter (what can still be common after the shared n-gram). Their
sets then meet the suffix filter (pivots of one set cut both into parts, whose sizes bound from below
what the sets differ in) and are intersected once a pair.

A class is named by the least of its rows' 64-bit hashes (of text and doc_id). Only who is connected counts, so pairs are not all written out:

1. Under every n-gram the other classes are compared with the earliest one alone. Groups of near
   copies fall together here, at a cost in proportion to their size.
2. What is still apart under a common n-gram is compared in full: as pairs where these are few, and
   where they are dense in groups of candidates whose pairs are formed in tasks, cell by cell.

An n-gram under which more than ``CELL`` classes stand is dealt into blocks; in step 2 the largest
connected part under it stays in its blocks and only the rest goes to all of them.

Defined cases: A-Z are lower-cased, nothing else; a text of fewer words than an n-gram is one n-gram; a
null text, or one without words, has an empty set and links with nothing, not even another empty
one; a null ``doc_id`` takes part and names a component only if nothing else can; repeated rows stay
repeated; a text may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_ids, saved
from .lines import KNOWN, PAIRS, RARITY_BITS, _groups, _roots, index_length, prefix_length, rarity
from .simhash import shingle_set
from .verify import cells, verified, with_few, within
from .words import Words, chunks, mix, split_words

WORDS, SIMILARITY = 5, 0.8
CELL = 2_048
#: Under one n-gram, pairs for each class up to which they are written out.
SPARSE = 4
_RANK = np.uint64(56)


def _blobs(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def runs(w: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``words`` words; a shorter text is one run."""
    n = len(w.hash) - words + 1
    out, owner = np.zeros(max(n, 0), np.uint64), np.zeros(0, np.int64)
    if n > 0:
        for i in range(words):
            out = out * np.uint64(0x9E3779B97F4A7C15) + w.hash[i : i + n]
            out ^= out >> np.uint64(29)
        inside = w.doc[:n] == w.doc[words - 1 :]
        out, owner = out[inside], w.doc[:n][inside]
    count = np.bincount(w.doc) if len(w.doc) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    begin = np.searchsorted(w.doc, short)
    more = [shingle_set(w.hash[b : b + count[d]], words) for d, b in zip(short, begin)]
    return mix(np.concatenate([out, *more])), np.concatenate([owner, short])


def ordered(part: list[bytes], words: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, rare first, and their text's number.

    An n-gram is a number whose upper eight bits are its rarity and whose others are its hash.
    """
    h, doc = runs(split_words(part), words)
    key = (ranks[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64) << _RANK) | (h >> np.uint64(8))
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[fresh], doc[fresh]


def _sketches(rows: DataFrame, words: int, similarity: float, ranks) -> DataFrame:
    """Every row's hash ``h``, ``doc_id``, set size ``n``, two sums over the set and the prefix of n-grams that others may hold.

    ``skip`` n-grams before the prefix are in no other document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for begin, part in chunks(_blobs(batch["text"].to_pylist())):
                key, doc = ordered(part, words, ranks.value)
                first = np.searchsorted(doc, np.arange(len(part)))
                n = np.diff(np.append(first, len(doc)))
                sums = []
                for x in (mix(key), mix(~key)):
                    total = np.zeros(len(part), np.int64)
                    total[n > 0] = np.add.reduceat(x, first[n > 0]).view(np.int64) if len(x) else 0
                    sums.append(total)
                fresh = np.zeros(len(part), bool)  # of repeated rows one gives its prefix
                for i, h in enumerate(batch["h"].slice(begin, len(part)).to_pylist()):
                    if h not in known:
                        known.add(h)
                        fresh[i] = True
                if len(known) > KNOWN:
                    known.clear()
                # smaller sets match equal ones only
                least = np.where(fresh & (n > 1 / (1 - similarity) - 1 - 1e-9), prefix_length(n, similarity), 0)
                ahead = np.arange(len(key)) - np.repeat(first, n) < np.repeat(least, n)
                lone = key >> _RANK == 0
                wanted = ahead & ~lone
                cut = np.append(0, np.bincount(doc[wanted], minlength=len(part)).cumsum())
                prefix = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key[wanted].view(np.int64)))
                skip = pa.array(np.bincount(doc[ahead & lone], minlength=len(part)), pa.int32())
                yield pa.record_batch([batch["h"].slice(begin, len(part)), batch["doc_id"].slice(begin, len(part)), pa.array(n, pa.int32()), *map(pa.array, sums), skip, prefix], names=["h", "doc_id", "n", "s1", "s2", "skip", "prefix"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"h long, doc_id {kind}, n int, s1 long, s2 long, skip int, prefix array<long>")


def _sets(rows: DataFrame, ids: DataFrame, words: int, ranks) -> DataFrame:
    """``id``, ``n`` and the whole set ``s`` of the rows whose hash is among the distinct ``ids``.

    Of repeated rows a task gives the first; those of several tasks may come several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            fresh = []
            for i, h in enumerate(batch["h"].to_pylist()):
                if h not in known:
                    known.add(h)
                    fresh.append(i)
            if len(known) > KNOWN:
                known.clear()
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            for begin, part in chunks(_blobs(batch["text"].to_pylist())):
                key, doc = ordered(part, words, ranks.value)
                cut = np.append(np.searchsorted(doc, np.arange(len(part))), len(doc)) * 8
                s = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(key.tobytes())])
                yield pa.record_batch([batch["h"].slice(begin, len(part)), pa.array(np.diff(cut) // 8, pa.int32()), s], names=["id", "n", "s"])

    return join_ids(rows.select("h", "text"), ids.select(F.col("id").alias("h")), "h", "left_semi").mapInArrow(run, "id long, n int, s binary")


def _near(n_i: np.ndarray, p_i: np.ndarray, n_j: np.ndarray, p_j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs pass the length, prefix and positional filters, by set sizes and the places of the shared n-gram."""
    low, high = np.minimum(n_i, n_j), np.maximum(n_i, n_j)
    inside = np.where(n_i <= n_j, p_i, p_j) < index_length(low, similarity)
    inside |= (n_i == n_j) & (p_j < index_length(low, similarity))
    need = np.ceil(similarity / (1 + similarity) * (n_i + n_j) - 1e-9)
    return (high * similarity <= low + 1e-9) & inside & (np.minimum(p_i, p_j) + np.minimum(n_i - p_i, n_j - p_j) >= need)


def _starred(posts: DataFrame, similarity: float) -> DataFrame:
    """Classes that share an n-gram with others: with the first of them where that may match.

    ``posts`` has ``g`` (n-gram, or a block of a common one), ``key``, ``id`` and ``np``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "g"):
            order = np.lexsort((rows["id"], rows["g"]))
            g, ids = rows["g"][order], rows["id"][order]
            order = order[np.append(True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]))]  # several tasks may have met a row
            g, key, ids, size = (rows[c][order] for c in ("g", "key", "id", "np"))
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            count = np.diff(np.append(first, len(g)))
            head = np.repeat(first, count)
            n, p = size >> 32, size & 0xFFFFFFFF
            other = ids != ids[head]
            ok = other & _near(n, p, n[head], p[head], similarity)
            some = np.repeat(count, count) > 1
            lead = pa.array(ids[head][some], mask=~ok[some])
            yield pa.record_batch([pa.array(key[some]), pa.array(g[some]), pa.array(ids[some]), pa.array(size[some]), lead, pa.array(~other[some])], names=["key", "g", "id", "np", "lead", "first"])

    return posts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "key long, g long, id long, np long, lead long, first boolean")


def _large(posts: DataFrame, cell: int) -> DataFrame:
    """N-grams under which more than ``cell`` classes stand, with the ``blocks`` into which they are dealt."""
    return saved(posts.groupBy("key").count().where(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).cast("int").alias("blocks")))


def _chunks(group: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within the length filter, ``PAIRS`` at a time; rows are sorted by group and ``n``."""
    last = np.searchsorted(group * (1 << 32) + n, group * (1 << 32) + np.floor(n / similarity + 1e-9).astype(np.int64), "right")
    count = last - np.arange(len(n)) - 1
    up, start = np.cumsum(count), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(up, (up[start - 1] if start else 0) + PAIRS, "right")))
        c = count[start:stop]
        i = np.repeat(np.arange(start, stop), c)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        start = stop


def _apart(shared: DataFrame, labels: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Candidate pairs of different components under a common n-gram, without those with its first class.

    Rows ``a``, ``b`` and ``dense``: where pairs are dense, a few edges tie all of them together.
    """
    named = shared.join(labels.withColumnRenamed("component", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
    open_keys = saved(named.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("key"))
    posts = saved(with_few(named, open_keys, "key", "left_semi").select("key", "id", "own", "np", F.shiftright("np", 32).alias("n"), F.coalesce("lead", F.lit(-1)).alias("lead")))
    placed = cells(posts, "key", cell).select("g", "id", "np", "own", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "g"):
            order = np.lexsort((rows["id"], rows["np"], rows["g"]))
            g, ids, size, own, lead = (rows[c][order] for c in ("g", "id", "np", "own", "lead"))
            n, p = size >> 32, size & 0xFFFFFFFF
            group = np.cumsum(np.append(False, g[1:] != g[:-1]))
            members = np.bincount(group)
            total, kept = np.zeros(len(members), np.int64), [np.zeros((0, 2), np.int64)]
            for i, j in _chunks(group, n, similarity):
                ok = (own[i] != own[j]) & (lead[i] != ids[j]) & (lead[j] != ids[i])
                i, j = i[ok], j[ok]
                ok = _near(n[i], p[i], n[j], p[j], similarity)
                i, j = i[ok], j[ok]
                count = np.bincount(group[i], minlength=len(members))
                total += count
                many = (count > SPARSE * members)[group[i]]
                kept.append(np.stack([i, j], 1)[~many])
                if many.any():  # no more edges than members, which tie the same
                    used, inner = np.unique(np.stack([i, j], 1)[many], return_inverse=True)
                    root = _roots(len(used), inner.reshape(-1, 2))
                    other = np.flatnonzero(root != np.arange(len(used)))
                    kept.append(np.stack([used[root[other]], used[other]], 1))
            pairs = np.concatenate(kept)
            if len(pairs):
                dense = (total > SPARSE * members)[group[pairs[:, 0]]]
                ends = ids[pairs]
                yield pa.record_batch({"a": pa.array(ends.min(1)), "b": pa.array(ends.max(1)), "dense": pa.array(dense)})

    return placed.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, dense boolean")


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``doc_id``, ``n_shingles`` (set size) and ``component_id``, the smallest ``doc_id`` reachable by links."""
    rows = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("h"))
    ranks = docs.sparkSession.sparkContext.broadcast(rarity(rows, lambda texts: (runs(split_words(part), words)[0] for _, part in chunks(_blobs(texts)))))  # 2**RARITY_BITS bytes
    own = saved(_sketches(rows, words, similarity, ranks))
    same = ["s1", "s2", "n"]
    classes = saved(own.where("n > 0").groupBy(*same).agg(F.min("h").alias("id"), F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    posts = join_ids(own.where(F.size("prefix") > 0), classes.select(F.col("id").alias("h")), "h", "left_semi")
    posts = posts.select(F.col("h").alias("id"), F.posexplode("prefix").alias("pos", "key"), F.shiftleft(F.col("n").cast("long"), 32).alias("_n"), "skip")
    posts = posts.select("key", "id", (F.col("_n") + F.col("skip") + F.col("pos")).alias("np"))
    # a common n-gram is common in its bucket
    often = F.shiftrightunsigned("key", 56) >= 1 + round(8 * np.log2(cell))
    large = _large(posts.where(often), cell)
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = posts.where(~often).select(F.col("key").alias("g"), "key", "id", "np").union(with_few(posts.where(often), large, "key").select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", block)).alias("g"), "key", "id", "np"))
    shared = saved(_starred(dealt, similarity))
    # the first classes of the blocks of a common n-gram are compared with the first of all
    heads = shared.where("first AND g <> key").select("key", "id")
    chief = heads.groupBy("key").agg(F.min("id").alias("a"))
    stars = shared.where("lead IS NOT NULL").select(F.col("lead").alias("a"), F.col("id").alias("b")).union(heads.join(chief, "key").where("a < id").select("a", F.col("id").alias("b")))
    stars = saved(stars.distinct())
    sets = lambda ids: _sets(rows, ids, words, ranks)
    links = saved(verified(stars, sets, similarity))
    labels = connected_components(links)
    left = saved(_apart(shared, labels, similarity, cell).distinct())
    pairs = saved(left.where("NOT dense").select("a", "b").join(stars, ["a", "b"], "left_anti"))
    groups = connected_components(left.where("dense"))
    linked = links.union(verified(pairs, sets, similarity)).union(within(groups, sets, labels, similarity, cell // 2))
    tops = connected_components(linked)
    named = classes.join(tops, "id", "left").withColumn("top", F.coalesce("component", "id"))
    least = named.where("component IS NOT NULL").groupBy("top").agg(F.min("first").alias("component_id"))
    found = saved(named.where("component IS NOT NULL").join(least, "top").select(*same, "component_id").union(named.where("component IS NULL AND copies > 1").select(*same, F.col("first").alias("component_id"))))
    out = with_few(own.select("doc_id", *same), found.withColumn("linked", F.lit(True)), same)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
