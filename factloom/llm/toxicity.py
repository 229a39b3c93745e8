"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Every sentence has a probability from a logistic model over
hashed features (its words and their beginnings), the document's is the noisy-or of its
sentences, and only document labels are known: the model is fitted by gradient descent on the
documents' likelihood. The sentences that carry a document's score are its offending ones.

The classifier is fitted in one task on a bounded sample of labelled rows (``SAMPLE`` rows of
either label, with their whole texts); scoring covers every whole text and needs only the
weights, whose size is fixed.

Defined cases: a null or empty text, or one without words, has no sentences and scores 0;
without labels of both kinds the model is empty and everything scores 0; a document with several
labels counts once for each, and equal texts with equal labels teach once; repeated rows score
alike; a sentence is one instance however long it is, and memory grows with the longest; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, mix, pieces

BITS = 18
#: Bytes of texts, and words of the sample, that are worked on at once.
PART, STEP = 1 << 18, 1 << 17
#: Characters of a text that are read at once; a longer one goes on after a sentence's end.
PIECE = 1 << 17
STOPS = ".!?\n…。！？"
SAMPLE = 3_000
#: Least probability of an offending sentence.
OFFENDING = 0.5
STEPS, RATE, DECAY = 120, 0.2, 1e-4
#: Features of fewer distinct taught documents than this have no weight.
LEAST_DOCS = 5
THRESHOLD = 0.7
CUTS = (3, 4, 5)
_POW = np.ones(64, np.uint64)
for _i in range(1, 64):
    _POW[_i] = (int(_POW[_i - 1]) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
_LETTER = np.array([chr(c).isalnum() for c in range(0x10000)])
_LETTER[ord("'")] = False
_STOP = np.zeros(0x10000, bool)
_STOP[[ord(c) for c in STOPS]] = True


class Sentences:
    """Sentences of a chunk of texts with the hashed features of their words."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts) + "\n"
        lower = joined.lower()
        if len(lower) != len(joined):  # a few letters change their number when lowered
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
        cps = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        plane = np.minimum(cps, 0xFFFF)
        letter = _LETTER[plane] | (cps > 0xFFFF)
        edge = np.flatnonzero(np.diff(letter, prepend=False))
        start, end = edge[::2], edge[1::2]
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        # a sentence ends at its stop marks; every text ends with the line break that joins them
        stop = np.flatnonzero(_STOP[plane])
        sentence = np.searchsorted(stop, start)
        self.ids, at_first = np.unique(sentence, return_index=True)
        last = np.append(at_first[1:], len(start)) - 1
        self.doc = np.searchsorted(offset, start[at_first], side="right") - 1
        self.begin, self.end = start[at_first] - offset[self.doc], end[last] - offset[self.doc]
        if not len(start):
            self.features, self.first = np.zeros((0, 1 + len(CUTS)), np.int32), at_first
            return
        at = np.flatnonzero(letter)
        length = end - start
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.minimum(np.arange(len(at)) - np.repeat(begin, length), 63)
        value = (cps[at].astype(np.uint64) + np.uint64(1)) * _POW[within]
        hashes = [np.add.reduceat(value, begin)]
        hashes += [np.add.reduceat(np.where(within < k, value, np.uint64(0)), begin) + np.uint64(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) for k in CUTS]
        # a word counts once in a sentence, however often it is repeated
        order = np.lexsort((hashes[0], sentence))
        fresh = np.append(True, (np.diff(hashes[0][order].view(np.int64)) != 0) | (np.diff(sentence[order]) != 0))
        kept = order[fresh]
        self.features = np.stack([(mix(h[kept]) >> np.uint64(64 - BITS)).astype(np.int32) for h in hashes], 1)
        self.first = np.searchsorted(sentence[kept], self.ids)


def _read(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, Sentences]]:
    """Sentences of all texts, some at a time, with the text and the offset of each of their pieces."""
    own = [(i, at, x.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) for at, x in pieces(t or "", PIECE, STOPS)]
    for begin, part in chunks([x for _, _, x in own], PART):
        index, offset, _ = zip(*own[begin : begin + len(part)])
        yield np.array(index), np.array(offset), Sentences([b.decode("utf-8", "surrogatepass") for b in part])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def scores(weights: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Probability of every text, and its offending sentences as (begin, end, probability).

    A text's pieces add up: the chance of no toxic sentence is the product over all sentences.
    """
    keep, found = np.zeros(len(texts)), [[] for _ in texts]
    for own, offset, s in _read(texts):
        if not len(s.ids):
            continue
        z = np.add.reduceat(weights[s.features].sum(1), s.first) + weights[-1]
        keep += np.bincount(own[s.doc], _softplus(z), len(texts))
        p = _sigmoid(z)
        for k in np.flatnonzero(p >= OFFENDING).tolist():
            at = int(offset[s.doc[k]])
            found[own[s.doc[k]]].append((at + int(s.begin[k]), at + int(s.end[k]), float(p[k])))
    return -np.expm1(-keep), found


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, least: int = LEAST_DOCS) -> np.ndarray:
    """Weights of the features and, last, the bias of a sentence.

    Adam on the mean weighted log-likelihood of the documents under the noisy-or. Its steps are
    small where gradients are, so words of a few documents gain little: labels are noisy.
    """
    feats, firsts, docs = [], [], []
    words, taught_by = 0, np.zeros(1 << BITS, np.int64)
    last = np.full(1 << BITS, -1)  # the last text that held a feature
    for own, _, s in _read(texts):
        feats.append(s.features)
        firsts.append(s.first + words)
        docs.append(own[s.doc])
        words += len(s.features)
        owner = np.repeat(own[s.doc], np.diff(np.append(s.first, len(s.features))))
        pairs = np.unique((np.repeat(owner, 1 + len(CUTS)) << BITS) | s.features.ravel())
        text, feature = pairs >> BITS, pairs & ((1 << BITS) - 1)
        fresh = text != last[feature]  # a text goes on from the chunk before
        taught_by += np.bincount(feature[fresh], minlength=1 << BITS)
        last[feature] = text  # pairs are sorted by text, so the last one stays
    first, d = np.concatenate(firsts), np.concatenate(docs)
    used = np.flatnonzero(taught_by >= least)
    place = np.full(1 << BITS, len(used), np.int32)  # the features left out share a weight that stays 0
    place[used] = np.arange(len(used))
    flat = np.concatenate([place[x] for x in feats])
    del feats
    sentence = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(flat))))
    steps_of = [slice(i, i + STEP) for i in range(0, len(flat), STEP)]
    each = np.zeros(len(flat))
    w, m, v = (np.zeros(len(used) + 2) for _ in range(3))
    w[-1] = -4.0
    share = weight / weight.sum()
    for t in range(1, steps + 1):
        for i in steps_of:
            each[i] = w[flat[i]].sum(1)
        z = np.add.reduceat(each, first) + w[-1]
        keep = np.bincount(d, _softplus(z), len(texts))  # -log of the chance of no toxic sentence
        p = -np.expm1(-keep)
        # d loss / d z: sigmoid(z) for clean documents, -sigmoid(z) (1 - p) / p for toxic ones
        factor = np.where(toxic, -(1 - p) / np.maximum(p, 1e-9), 1.0) * share
        g = factor[d] * _sigmoid(z)
        grad = np.append(np.zeros(len(used) + 1), g.sum())
        for i in steps_of:
            grad[:-1] += np.bincount(flat[i].ravel(), np.repeat(g[sentence[i]], flat.shape[1]), len(used) + 1)
        grad[:-2] += decay * w[:-2]
        grad[-2] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-3)
    full = np.zeros((1 << BITS) + 1, np.float32)
    full[used] = w[:-2]
    full[-1] = w[-1]
    return full


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on labelled ``docs``; ``usable``, of the ``doc_id``, says which rows may teach.

    The sample has about ``sample`` ids of either label, chosen by a hash of the id, so its ids are
    broadcast and texts stay where they are. Should rows repeat their ids, the sample ends at
    ``4 * sample`` rows in order of a hash. One task fits it; only the weights, of fixed size, come
    to the driver.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic").distinct()
    known = known.where(usable) if usable is not None else known  # a label that may not teach counts for nothing
    rows = docs.select("doc_id", "text").where("text <> ''")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {k: min(1.0, sample / max(1, counts.get(k, 0))) for k in (0, 1)}
    u = F.pmod(F.xxhash64("doc_id", F.lit("teach")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = known.where(u < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    taught = rows.join(F.broadcast(drawn), "doc_id").select("text", "toxic", F.col("doc_id").cast("string").alias("id"))
    # the sample is bounded, so its texts may meet in one task
    taught = taught.orderBy(F.xxhash64("id", "text"), "id", "text", "toxic").limit(4 * sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        pdf = pd.concat(frames).sort_values(["id", "text"]).drop_duplicates(["text", "toxic"]) if frames else pd.DataFrame({"text": [], "toxic": []})
        toxic = pdf["toxic"].to_numpy() == 1
        if toxic.any() and not toxic.all():
            weight = np.where(toxic, 1 / rate[1], 1 / rate[0])
            yield pd.DataFrame({"w": [fit(pdf["text"].tolist(), toxic, weight).tobytes()]})

    found = taught.coalesce(1).mapInPandas(run, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32) if found else np.append(np.zeros(1 << BITS, np.float32), np.float32(-np.inf))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with the ``score`` of every whole text and its ``offending`` sentences.

    These are structs of begin, end (code points) and probability, of ``OFFENDING`` or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # fixed size: 2**BITS + 1 numbers

    @F.pandas_udf("score double, offending array<struct<begin:long,end:long,probability:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        p, found = scores(shared.value, texts.tolist())
        return pd.DataFrame({"score": p, "offending": [[{"begin": a, "end": b, "probability": x} for a, b, x in spans] for spans in found]})

    kept = [c for c in docs.columns if c not in ("score", "offending")]
    return docs.withColumn("_toxicity", run("text")).select(*kept, "_toxicity.*")


def reject(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, in all their columns."""
    scored = score(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), weights)
    return scored.where(F.col("score") < threshold).select("_doc.*")


def offending(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per offending sentence: doc_id, begin, end (code points), probability."""
    return score(docs.select("doc_id", "text"), weights).select("doc_id", F.inline("offending"))


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id, which belongs to no fold."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(modulus)), F.lit(-1))
