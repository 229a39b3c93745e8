"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Two lines match when the Jaccard similarity of their
sets is ``similarity`` or more; a line that matches an earlier one (by doc_id, then line) is a
later match and is removed.

Lines of equal sets form a class first, so copies are never paired. Words are ordered by rarity,
counted over all lines in ``2**RARITY_BITS`` buckets of word hashes; the order only has to be the
same for all lines, so buckets do not make the join inexact. Of two matching lines the longer one
has, among its ``n - ceil(similarity * n) + 1`` rarest words, one of the ``n - ceil(2 * similarity
/ (1 + similarity) * n) + 1`` rarest words of the shorter. So the lines of a word are sorted by
length, every line is compared with the longer ones that follow it within the length filter, and
what passes the position filter (what can still be common after the shared word) and the parity
bits of the words, a lower bound of what two sets differ in, ties classes into groups; within a
group the word sets are intersected exactly. A word or a group with more than ``CELL`` classes is
dealt into cells of two blocks each, so no task holds more than two blocks and no pair is sent
anywhere: tasks return at most one row per class, with its number of matches and its earliest.

Defined cases: lines end at line feeds; lines without words, and null texts, match nothing; a
document's repeated lines match each other; a null doc_id sorts first; among rows of one doc_id
the order is that of their texts' hashes, and among repeated rows one stays; a text may have any
number of lines, and a line any number of words; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, connected_components, saved
from .words import Words, chunks, mix, split_words

SIMILARITY = 0.8
RARITY_BITS = 20
CELL = 2_048
#: Pairs of lines that are compared, words that are ordered, classes that a task remembers and rows that
#: are grouped at once.
PAIRS, RUN, KNOWN, GROUPS = 1 << 20, 1 << 19, 1 << 18, 1 << 16
#: Members of the groups that are verified many at once.
FEW = 24
#: Lines of a text that are looked up in one row.
LISTED = 1 << 16
#: Words of a line from which on 64 parity bits say too little.
LONG = 64
_SHIFT = np.uint64(64 - RARITY_BITS)
#: The place of a line among all: by document, then text, row and line.
ORDER = ["doc_id", "h", "row", "line"]


def _blobs(texts) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


def _word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    return (split_words(part).hash for _, part in chunks(_blobs(texts)))


def rarity(docs: DataFrame, hashes: Callable[[list[str | None]], Iterator[np.ndarray]] = _word_hashes) -> np.ndarray:
    """Rank of each bucket of the ``hashes`` of all texts by what is counted in it, as a number from 0 to 255.

    A bucket with a single hash in all texts is 0: that one can't be shared. Every task adds up
    its own counts first; what reaches the driver has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for h in hashes(batch["text"].to_pylist()):
                total += np.bincount((h >> _SHIFT).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            own = at[i : i + (1 << 16)]
            yield pa.record_batch({"k": pa.array(own, pa.int32()), "n": pa.array(total[own], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = counted.select("k", F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(255), F.round(F.log2("n") * 8) + 1)).cast("short").alias("r"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": [pdf["k"].to_numpy(np.int32).tobytes()], "r": [pdf["r"].to_numpy(np.uint8).tobytes()]})

    out = np.zeros(1 << RARITY_BITS, np.uint8)
    for x in found.mapInPandas(pack, "k binary, r binary").toLocalIterator():  # five bytes a bucket
        out[np.frombuffer(x["k"], np.int32)] = np.frombuffer(x["r"], np.uint8)
    return out


def _sets(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order that sorts words by line, rarity and hash, without repeats within a line.

    ``line`` counts from 0 and stays below 2**20.
    """
    key = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
    order = np.argsort(key)
    k = key[order]
    tie = np.flatnonzero(k[1:] == k[:-1])
    if len(tie) and (h[order[tie]] != h[order[tie + 1]]).any():  # hashes that agree in 36 bits only
        order = np.lexsort((h, rank, line))
    x, y = h[order], line[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order[keep]


def _runs(w: Words) -> Iterator[slice]:
    """Whole lines of about ``RUN`` words at a time, so of fewer lines; a longer line stands alone."""
    begin = 0
    first = np.flatnonzero(np.diff(w.line, prepend=-1, append=-1)) if len(w.line) else np.zeros(1, np.int64)
    while begin < len(w.line):
        k = np.searchsorted(first, begin + RUN, "right") - 1
        end = int(first[k]) if first[k] > begin else int(first[k + 1])
        yield slice(begin, end)
        begin = end


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """Rarest words of a line that are looked up among those of shorter lines."""
    return n - _ceil(similarity * n) + 1


def index_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """Rarest words of a line among which longer lines find it."""
    return n - _ceil(2 * similarity / (1 + similarity) * n) + 1


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, a hash ``h`` of the text and a number ``row`` of each row."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))


def _lines(rows: DataFrame, ranks: np.ndarray, similarity: float, cell: int) -> DataFrame:
    """Every line with words: its place, n (set size), two sums of its words' hashes, their
    parity bits and the shareable words of its prefix with their positions; those that more than
    ``cell`` lines may hold are ``hot``.

    Lines of one class have equal words, so a task gives them with the first that it meets.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)  # 2**RARITY_BITS bytes
    hot = 1 + round(8 * np.log2(cell))
    names = [*ORDER, "n", "s1", "s2", "b1", "b2", "words", "places", "hot_words", "hot_places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for begin, part in chunks(_blobs(batch["text"].to_pylist())):
                w = split_words(part)
                for s in _runs(w):
                    far = w.line[s] - w.line[s.start]  # lines without words leave gaps of any size
                    line = np.cumsum(np.diff(far, prepend=0) != 0)
                    rank = shared.value[(w.hash[s] >> _SHIFT).astype(np.int64)]
                    order = _sets(w.hash[s], line, rank)
                    h, line, rank, doc, far = w.hash[s][order], line[order], rank[order], w.doc[s][order], far[order]
                    first = np.flatnonzero(np.diff(line, prepend=-1))
                    n = np.diff(np.append(first, len(line)))
                    place = np.arange(len(h)) - np.repeat(first, n)
                    sums = [np.add.reduceat(x, first).view(np.int64) for x in (mix(h), mix(~h))]
                    # 64 parity bits, each word flips one; of long lines also those of half the words
                    flip, half = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(1) == 0
                    bits = [np.bitwise_xor.reduceat(x, first).view(np.int64) for x in (flip, np.where(half, flip, np.uint64(0)))]
                    bits[1][n <= LONG] = 0
                    fresh = np.zeros(len(n), bool)
                    for i, x in enumerate(sums[0].tolist()):
                        if x not in known:
                            known.add(x)
                            fresh[i] = True
                    if len(known) > KNOWN:
                        known.clear()
                    least = np.where(fresh & (n > 1 / (1 - similarity) - 1 - 1e-9), prefix_length(n, similarity), 0)  # shorter lines match equal ones only
                    wanted = (place < np.repeat(least, n)) & (rank > 0)
                    lists = []
                    for mine in (wanted & (rank < hot), wanted & (rank >= hot)):
                        cut = pa.array(np.append(0, np.add.reduceat(mine, first, dtype=np.int64).cumsum()), pa.int32())
                        lists += [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (h[mine].view(np.int64), place[mine].astype(np.int32))]
                    own = pa.array(begin + doc[first])
                    place_of = [batch["doc_id"].take(own), batch["h"].take(own), batch["row"].take(own), pa.array(far[first] + w.line[s.start] - w.first_line[doc[first]], pa.int64())]
                    yield pa.record_batch([*place_of, pa.array(n, pa.int32()), *map(pa.array, sums + bits), *lists], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, row long, line long, n int, s1 long, s2 long, b1 long, b2 long, words array<long>, places array<int>, hot_words array<long>, hot_places array<int>")


def survivors(group: np.ndarray, rows: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one ``group`` that share a prefix word and pass all filters.

    ``rows`` are sorted by group and length, so the partners of a row are a run after it.
    """
    n, place, b1, b2, ids = (rows[c] for c in ("n", "place", "b1", "b2", "id"))
    key = group * (1 << 32) + n
    last = np.searchsorted(key, group * (1 << 32) + np.floor(n / similarity + 1e-9).astype(np.int64), "right")
    count = np.where(place < index_length(n, similarity), last - np.arange(len(n)) - 1, 0)
    up = np.cumsum(count)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(up, (up[start - 1] if start else 0) + PAIRS, "right")))
        c = count[start:stop]
        i = np.repeat(np.arange(start, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        need = _ceil(similarity / (1 + similarity) * (n[i] + n[j]))
        ok = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= need
        i, j, most = i[ok], j[ok], (n[i] + n[j] - 2 * need)[ok]
        whole, half = b1[i] ^ b1[j], np.where(n[i] > LONG, b2[i] ^ b2[j], 0)  # the shorter is i
        ok = (np.bitwise_count(whole ^ half).astype(np.int64) + np.bitwise_count(half) <= most) & (ids[i] != ids[j])
        yield i[ok], j[ok]
        start = stop


def _roots(size: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, by repeated minima over the pairs."""
    root = np.arange(size)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def _stream(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches that never part rows of equal ``by``, from input sorted by it."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = pdf[by].to_numpy()[-1]
        tail = (pdf[by].to_numpy() == last).all(1)
        begin = len(pdf) if tail.all() else int(np.flatnonzero(~tail)[-1]) + 1
        if tail.all():
            if held and not (held[0][by].to_numpy()[-1] == last).all():
                yield pd.concat(held)
                held = []
            held.append(pdf)
            continue
        head = pdf.iloc[:begin]
        yield pd.concat([*held, head]) if held else head
        held = [pdf.iloc[begin:]]
    if held:
        yield pd.concat(held)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups of equal ``by``, from number columns sorted by it, about ``GROUPS`` rows at a time."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch[c].to_numpy() for c in batch.schema.names})
        rows += batch.num_rows
        if rows < GROUPS or held[-1][by][-1] == held[0][by][0]:
            continue
        part = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        cut = int(np.searchsorted(part[by], part[by][-1]))  # the last group may go on
        yield {c: v[:cut] for c, v in part.items()}
        held, rows = [{c: v[cut:] for c, v in part.items()}], len(part[by]) - cut
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def candidate_edges(lines: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """Edges ``a``, ``b`` between classes, named by ``s1``, that hold every candidate pair in one component."""
    def posts(words: str, places: str) -> DataFrame:
        each = lines.select(F.col("s1").alias("id"), "n", "b1", "b2", F.inline(F.arrays_zip(F.col(words).alias("word"), F.col(places).alias("place"))))
        return each.toDF("id", "n", "b1", "b2", "word", "place")

    row = ["id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place")).alias("np"), "b1", "b2"]
    some = _celled(posts("hot_words", "hot_places"), "word", cell)
    # a cell of a word is a key like a word: were two keys equal, they would add candidates, and lose none
    key = F.when(F.col("cell") == 0, F.col("word")).otherwise(F.xxhash64("word", "cell"))
    dealt = posts("words", "places").select(F.col("word").alias("key"), *row).union(some.select(key.alias("key"), *row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "key"):
            # rows come sorted by key: its number, the set's size and the place make one number to sort by
            number = np.cumsum(np.append(False, rows["key"][1:] != rows["key"][:-1]))
            n, place = rows["np"] >> 32, rows["np"] & 0xFFFFFFFF
            if int(n.max()) < 1 << 20 and int(number[-1]) < 1 << 23:
                order = np.argsort((number << 40) | (n << 20) | place)
            else:
                order = np.lexsort((place, n, number))
            rows = {c: v[order] for c, v in rows.items()}
            again = np.append(False, np.all([rows[c][1:] == rows[c][:-1] for c in ("key", "np", "id", "b1")], axis=0))  # several tasks may have met a class
            rows = {c: v[~again] for c, v in rows.items()}
            group = np.cumsum(np.append(False, rows["key"][1:] != rows["key"][:-1]))
            rows["n"], rows["place"] = rows["np"] >> 32, rows["np"] & 0xFFFFFFFF
            pairs = [np.stack([i, j], 1) for i, j in survivors(group, rows, similarity) if len(i)]
            if pairs:
                # members of a word that are tied need no more edges than members
                found = np.concatenate(pairs)
                used, inner = np.unique(found, return_inverse=True)
                root = _roots(len(used), inner.reshape(-1, 2))
                other = np.flatnonzero(root != np.arange(len(used)))
                ids = rows["id"][used]
                edges = np.unique(np.stack([ids[root[other]], ids[other]], 1), axis=0)
                yield pa.record_batch({"a": edges[:, 0], "b": edges[:, 1]})

    # one sort column is sorted by radix; the order within a key is made in the task
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _celled(rows: DataFrame, key: str, cell: int) -> DataFrame:
    """``rows`` with a ``cell``: 0 for keys of up to ``cell`` rows, else one of its block pairs.

    Members of a large key are dealt into blocks by a hash of their id and go to every cell that
    holds their block, so all pairs meet while a cell stays small.
    """
    large = saved(rows.groupBy(key).count().where(F.col("count") > cell).select(F.col(key).alias("_key"), F.ceil(F.col("count") * 2 / cell).cast("int").alias("_blocks")))
    if large.isEmpty():
        return rows.withColumn("cell", F.lit(0)).withColumn("block", F.lit(0))
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    few = large.count() <= BROADCAST_IDS  # at most one in ``cell`` rows
    dealt = rows.join(F.broadcast(large) if few else large, F.col(key) == F.col("_key"), "left").withColumn("block", F.coalesce(own, F.lit(0)))
    cells = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.least(b, F.col("block")) * F.col("_blocks") + F.greatest(b, F.col("block")) + 1))
    return dealt.withColumn("cell", F.explode(cells)).drop("_key", "_blocks")


def _matches(sets: list[np.ndarray], block: np.ndarray, mixed: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of matching sets and the first of them (itself, if none earlier) for each set of a cell.

    Pairs within one block belong to that block's own cell, so that each counts once.
    """
    n = np.array([len(s) for s in sets])
    vocabulary, number = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(number)
    column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[number]  # words of one set are common to no pair
    row = np.repeat(np.arange(len(sets)), n)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[order], np.arange(0, int(column.max()) + 2048, 2048))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        wide = min(2048, int(column.max()) + 1 - 2048 * k)
        table = np.zeros((len(sets), wide), np.float32)
        table[row[order[a:b]], column[order[a:b]] - 2048 * k] = 1
        common += table @ table.T
    ok = common >= similarity * (n[:, None] + n[None, :] - common) - 1e-4
    np.fill_diagonal(ok, False)
    if mixed:
        ok &= block[:, None] != block[None, :]
    return ok.sum(1), np.minimum(np.where(ok.any(1), ok.argmax(1), len(sets)), np.arange(len(sets)))


def _small_matches(sets: list[np.ndarray], begin: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_matches` for many groups of few sets at once: ``begin`` and ``size`` of each group."""
    n = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(n)))
    links, first = np.zeros(len(sets), np.int64), np.arange(len(sets))
    pairs = [np.stack([begin[size >= k] + i, begin[size >= k] + k - 1], 1) for k in range(2, int(size.max(initial=0)) + 1) for i in range(k - 1)]
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    words = (n[pairs[:, 0]] + n[pairs[:, 1]]).cumsum()
    start = 0
    while start < len(pairs):
        stop = max(start + 1, int(np.searchsorted(words, (words[start - 1] if start else 0) + RUN, "right")))
        part = pairs[start:stop]
        ends = part.ravel()
        number = np.repeat(np.arange(len(ends)) // 2, n[ends])
        word = flat[np.repeat(at[ends] - np.cumsum(n[ends]) + n[ends], n[ends]) + np.arange(len(number))]
        order = np.lexsort((word, number))
        word, number = word[order], number[order]
        common = np.bincount(number[1:][(word[1:] == word[:-1]) & (number[1:] == number[:-1])], minlength=len(part))
        i, j = part[common >= similarity * (n[part].sum(1) - common) - 1e-4].T
        np.add.at(links, i, 1)
        np.add.at(links, j, 1)
        np.minimum.at(first, j, i)
        start = stop
    return links, first


def join_rows(rows: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``join_lines`` for :func:`identified` rows, with the ``row`` of every line."""
    lines = saved(_lines(rows, rarity(rows), similarity, cell))
    key = ["s1", "s2", "n"]
    classes = lines.groupBy(*key).agg(F.min(F.struct(*ORDER)).alias("m"), F.count("*").alias("lines"))
    classes = saved(classes.select(*key, "m.*", "lines", F.monotonically_increasing_id().alias("id")))
    groups = connected_components(candidate_edges(lines, similarity, cell))
    members = saved(groups.withColumnRenamed("id", "s1").join(classes, "s1"))
    found = _verified(rows, members, similarity, cell).groupBy("id").agg(F.sum("links").alias("n_links"), F.min("first").alias("first"))
    # a line that is alone in its class and links to none is the first itself
    named = classes.where("lines > 1").select("id", *key, F.struct(*ORDER).alias("m")).join(found, "id", "full")
    own = members.select("id", *[F.col(c).alias(f"_{c}") for c in key], F.struct(*ORDER).alias("_m"))
    named = named.join(own, "id", "left").select(*[F.coalesce(c, f"_{c}").alias(c) for c in key], "n_links", F.coalesce("first", "m", "_m").alias("first"))
    named = saved(named)
    few = named.count() <= BROADCAST_IDS // 4
    out = lines.select(*ORDER, *key).join(F.broadcast(named) if few else named, key, "left").withColumn("first", F.coalesce("first", F.struct(*ORDER)))
    removed = ~F.struct(*ORDER).eqNullSafe(F.col("first"))
    name = F.concat(*[F.lpad(F.lower(F.hex(s)), 16, "0") for s in ("s1", "s2")]).alias("class_id")
    return out.select("row", "doc_id", "line", name, F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), F.coalesce("n_links", F.lit(0)).alias("n_links"), removed.alias("removed"))


def join_lines(docs: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Every line with words: ``doc_id, line, class_id, first_doc_id, first_line, n_links, removed``.

    ``class_id`` names lines of equal word sets; ``n_links`` counts the other classes that match;
    ``first_*`` name the earliest line that is equal or matches, and ``removed`` says that it is
    another line.
    """
    return join_rows(identified(docs), similarity, cell).drop("row")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` whose texts have lost the lines that match an earlier one."""
    numbered = saved(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select("doc_id", "text", F.xxhash64("text").alias("h"), F.col("_row").alias("row"))
    gone = join_rows(rows, similarity).where("removed").groupBy(F.col("row").alias("_row")).agg(F.collect_set("line").alias("_gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i.cast("long")))
    whole = numbered.join(gone, "_row", "left")
    return whole.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(docs.columns)


def _verified(rows: DataFrame, members: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Exact matches within groups: id, links and the earliest match, one row per class and cell."""
    # a long text's lines come in several rows, so that none grows with the text
    wanted = saved(members.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), F.floor(F.col("line") / LISTED).alias("_part")).agg(F.collect_list(F.struct("row", "line", "id", "component", "n", "s1", "s2")).alias("lines")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch["lines"].to_pylist()
            found = []
            for begin, part in chunks(_blobs(batch["text"].to_pylist())):
                w = split_words(part)
                for d in range(len(part)):
                    for r in lines[begin + d]:
                        a, b = np.searchsorted(w.line, (w.first_line[d] + r["line"], w.first_line[d] + r["line"] + 1))
                        s = np.unique(w.hash[a:b])
                        # rows may share an id and a hash: only the class's own line counts
                        if len(s) == r["n"] and all(int(mix(x).sum(dtype=np.uint64).view(np.int64)) == r[k] for k, x in (("s1", s), ("s2", ~s))):
                            found.append((r["id"], r["component"], begin + d, r["row"], r["line"], s.tobytes()))
            if found:
                ids, component, at, row, line, s = zip(*found)
                own = pa.array(at)
                yield pa.record_batch([pa.array(ids), pa.array(component), batch["doc_id"].take(own), batch["h"].take(own), pa.array(row), pa.array(line), pa.array(s, pa.binary())], names=["id", "component", *ORDER, "s"])

    few = members.count() <= BROADCAST_IDS // 10  # lines, of some 60 bytes each
    texts = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(F.col("_doc")) & rows["h"].eqNullSafe(F.col("_h"))).select("doc_id", "h", "text", "lines")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = saved(texts.mapInArrow(sets, f"id long, component long, doc_id {kind}, h long, row long, line long, s binary").dropDuplicates(["id"]))
    dealt = _celled(found, "component", cell)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _stream(batches, ["component", "cell"]):
            component, cells, ids, block = (pdf[c].to_numpy() for c in ("component", "cell", "id", "block"))
            begin = np.flatnonzero(np.append(True, (component[1:] != component[:-1]) | (cells[1:] != cells[:-1])))
            all_sets = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
            size = np.diff(np.append(begin, len(pdf)))
            small = (size > 1) & (size <= FEW)
            out = []
            if small.any():
                # a cell of two blocks may be small too: pairs of one block count in their own cell
                one = np.array([block[a : a + k].min() == block[a : a + k].max() for a, k in zip(begin[small].tolist(), size[small].tolist())])
                small[np.flatnonzero(small)[~one]] = False
                links, first = _small_matches(all_sets, begin[small], size[small], similarity)
                at = np.flatnonzero(np.repeat(small, size))
                out.append(np.stack([ids[at], links[at], ids[first[at]]], 1))
            for a, k in zip(begin[(size > 1) & ~small].tolist(), size[(size > 1) & ~small].tolist()):
                own = block[a : a + k]
                links, first = _matches(all_sets[a : a + k], own, bool(own.min() != own.max()), similarity)
                out.append(np.stack([ids[a : a + k], links, ids[a + first]], 1))
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["id", "links", "first_id"])

    order = dealt.repartition("component", "cell").sortWithinPartitions("component", "cell", *ORDER).select("component", "cell", "block", "id", "s")
    compared = order.mapInPandas(run, "id long, links long, first_id long")
    places = members.select(F.col("id").alias("first_id"), F.struct(*ORDER).alias("first"))
    return compared.join(places, "first_id").select("id", "links", "first")
