"""SimHash fingerprints and near-duplicate removal.

Fingerprints link when few bits differ. Candidates come from pigeonring filtering: the
bits form a ring of ``max_bits + 1`` segments, and two fingerprints within ``max_bits`` must
have a segment from which every chain of ``l`` consecutive segments differs in at most
``floor(l * max_bits / segments)`` bits. Such a chain starts with an equal segment followed by
one with at most one differing bit, so an equality join on the first two segments (one side
also tries each single bit flip of the second) finds all of them without pairing up the
members of a segment; the longer chains and the full distance are checked on the joined rows.

``near_duplicates`` serves corpora in which copies have up to a tenth of their shingles
changed. A 64-bit SimHash then often differs in 5 to 15 bits, which no exact filter can find at
scale, so there the fingerprint links are joined by candidates from minimum hashes of the same
shingles. Candidates of either kind tie documents into groups. The pairs that tie them are verified
by the exact Jaccard similarity, then all pairs of a group that are not connected yet.

Defined cases: null or empty text and text of white space have fingerprint zero and link like
any other; a text of fewer words than a shingle is one shingle; rows with equal texts share a
component; repeated rows stay repeated; a null ``doc_id`` keeps its fingerprint and never names
a component unless nothing else can. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_ids, released, saved
from .verify import verified, with_few, within
from .words import chunks, split_words

BLOCK = 1 << 15
#: Bytes of texts whose words are found at once.
PART = 1 << 18


def shingles(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of a text; A-Z are lower-cased, nothing else changes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [h(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return [h(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and the signed 64-bit ``fp`` of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.fromiter((majority(np.array(shingles(t, words), np.uint64)) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(released(run), f"doc_id {kind}, fp long")


def hexed(fp: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fp``) with at most ``max_bits`` differing bits."""
    m = max_bits + 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    seg = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(m)]
    chain = [[0] for _ in range(m)]
    for i in range(m):
        for n in range(m):
            chain[i].append(chain[i][-1] | seg[(i + n) % m])
    two = min(2, m)
    keys = ", ".join(f"struct({i} AS ring, fp & {_signed(chain[i][two])}L AS key)" for i in range(m))
    home = fps.select(F.col("fp").alias("y"), F.expr(f"inline(array({keys}))"))
    tries = []
    for i in range(m):
        key = f"(fp & {_signed(chain[i][two])}L)"
        flips = [_signed(1 << b) for b in range(64) if m > 1 and seg[(i + 1) % m] >> b & 1]
        # flipping set bits is enough: of two fingerprints that differ in one bit, one has it set
        tries.append(f"transform(filter(array({', '.join(f'{x}L' for x in [0, *flips])}), f -> f = 0 OR (fp & f) <> 0), f -> struct({i} AS ring, {key} ^ f AS key, f = 0 AS same))")
    probe = fps.select(F.col("fp").alias("x"), F.expr(f"inline(concat({', '.join(tries)}))"))
    # Spark sizes what an inline makes by the rows before it, so neither side is left to be broadcast
    pairs = home.join(probe.hint("merge"), ["ring", "key"]).where("CASE WHEN same THEN x < y ELSE x <> y END").where(f"bit_count(x ^ y) <= {max_bits}")
    for n in range(3, m):
        ok = " ".join(f"WHEN {i} THEN bit_count((x ^ y) & {_signed(chain[i][n])}L) <= {n * max_bits // m}" for i in range(m))
        pairs = pairs.where(f"CASE ring {ok} END")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest ``doc_id`` reachable over links."""
    own = saved(fingerprints(docs, words))
    distinct = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(links(distinct, max_bits))
    group = distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("top", F.coalesce("component", "fp"))
    least = group.groupBy("top").agg(F.min("first").alias("component_id"))
    # only fingerprints with links look up their component's smallest member
    named = saved(group.where("component IS NULL").select("fp", F.col("first").alias("component_id")).union(group.where("component IS NOT NULL").join(least, "top").select("fp", "component_id")))
    return own.join(named, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


# --- near duplicates by shingle similarity -------------------------------------------------

#: Minimum hashes of a text and how many of them make a band. A pair of similarity 0.8 shares
#: a band with probability 1 - (1 - 0.8**4)**16 = 0.9998.
BANDS, ROWS = 16, 4
#: Members of a group of candidates that are compared in one piece.
CELL = 1_024
_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def _shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, whose words are lower-cased."""
    blobs = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    for _, part in chunks(blobs, PART):
        w = split_words(part)
        bounds = np.searchsorted(w.doc, np.arange(len(part) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield shingle_set(w.hash[a:b], words)


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` word hashes; a shorter text is one run."""
    n = max(1, len(h) - words + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _minima(s: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        x = s[i : i + 4096, None] * _MUL + _ADD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
    return low


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 2, cell: int = CELL) -> DataFrame:
    """Ids of the documents of groups of near copies: ``doc_id`` and ``group_id``, its smallest.

    Two documents are linked when the sets of their ``words``-word shingles (lower-cased) have
    Jaccard similarity of ``similarity`` or more; groups are connected. Documents without a link
    do not appear. Texts of equal shingle sets are one text here and are linked to each other.
    ``doc_id`` must be a long that no two rows share; texts without words take no part.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, size, same, fps, bands = [], [], [], [], []
            for i, s in zip(pdf["doc_id"].tolist(), _shingle_sets(pdf["text"].tolist(), words)):
                if len(s):
                    ids.append(i)
                    size.append(len(s))
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    fps.append(majority(s))
                    low = _minima(s).reshape(BANDS, ROWS)
                    bands.append([xxhash.xxh64_intdigest(low[k].tobytes(), k) - (1 << 63) for k in range(BANDS)])
            yield pd.DataFrame({"doc_id": ids, "n": size, "same": same, "fp": np.array(fps, np.uint64).view(np.int64), "bands": bands})

    rows = docs.select("doc_id", "text")
    sketches = saved(rows.mapInPandas(released(sketch), "doc_id long, n int, same binary, fp long, bands array<long>"))
    # one document of each group of equal sets goes on; the others are tied to it
    first = saved(sketches.groupBy("same").agg(F.min("doc_id").alias("first")))
    copies = sketches.select("doc_id", "same").join(first, "same").where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    distinct = saved(join_ids(sketches, first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"))
    # documents that share a band or nearly a fingerprint are tied into groups of candidates, at a cost in
    # proportion to them: with the first of a band, and with a fingerprint's owner
    band = distinct.select("doc_id", F.posexplode("bands").alias("k", "band"))
    lead = band.groupBy("k", "band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("high")).where("a < high").drop("high")
    candidates = band.join(lead.hint("merge"), ["k", "band"]).where("doc_id > a").select("a", F.col("doc_id").alias("b"))
    owner = distinct.groupBy("fp").agg(F.min("doc_id").alias("id"))
    near = links(distinct.select("fp").distinct(), max_bits)
    by_fp = near.join(owner.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a").join(owner.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal_fp = distinct.select("fp", "doc_id").join(owner, "fp").where("doc_id > id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    tied = saved(candidates.union(by_fp).union(equal_fp).distinct())

    def sets(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = list(_shingle_sets(pdf["text"].tolist(), words))
                yield pd.DataFrame({"id": pdf["doc_id"], "n": [len(s) for s in found], "s": [s.tobytes() for s in found]})

        return join_ids(rows, ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInPandas(released(run), "id long, n int, s binary")

    # these pairs first: most groups fall together; then all pairs of a group that are still apart
    real = saved(verified(tied, sets, similarity))
    labels = connected_components(real)
    groups = connected_components(tied)
    own = groups.join(labels.withColumnRenamed("component", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
    apart = saved(own.groupBy("component").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("component"))
    rest = within(saved(with_few(groups, apart, "component", "left_semi")), sets, labels, similarity, cell)
    return connected_components(copies.union(real).union(rest)).select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, stored: bool = False) -> DataFrame:
    """The documents without the later members of each group of near copies, in all their columns.

    The first of a group has the smallest ``doc_id``; null comes last, and of equal ids one row stays.
    Rows are known by their number, so that a row goes for its own text only; they are written with it,
    unless ``docs`` are ``stored``: rows of files have the same numbers at every reading. Texts without
    words all stay.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    numbered = numbered if stored else saved(numbered)
    groups = saved(near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text"), words, similarity).toDF("_row", "group"))
    named = with_few(numbered.select("_row", "doc_id"), groups, "_row", "inner")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")).select("group", F.col("m._row").alias("_first"))
    gone = named.join(first, "group").where("_row <> _first").select("_row")
    return join_ids(numbered, gone, "_row", "left_anti").select(docs.columns)
