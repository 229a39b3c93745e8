"""Language of whole texts, with spans for texts in several languages.

Every language has naive-Bayes weights for hashed character runs of one to three letters within
word boundaries, counted over the taught documents. The scripts of a word's letters narrow the
candidates to the languages that were taught in that script; then Viterbi over the words'
scores, with a penalty for every switch, labels spans. A document's language is the one that
labels most letters, and its score that share.

Counts for teaching are made in Spark tasks over at most about ``SAMPLE`` usable rows of each
language and have a fixed size per language.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without taught rows
every text is ``und``; rows with a null language don't teach; letters of a script that no
language was taught in leave all candidates; equal languages in a tie go by code point order;
repeated rows are labelled alike; the words of a text of more than ``PIECE`` characters are scored in
pieces cut between words, and its path goes over all of them; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, mix

BITS = 15
#: Rows of each language that teach.
SAMPLE = 5_000
SWITCH = 12.0
#: No word counts for more than this many nats between languages.
CLIP = 8.0
#: Characters of a text whose words are scored at once; of all its words the scores are kept.
PIECE = 1 << 18


def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: its script (0 for no letter), its lower case and whether it is a letter.

    A script is what letters' names begin with, so every script of every plane is its own class.
    """
    script, lower = np.zeros(sys.maxunicode + 1, np.int16), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    number: dict[str, int] = {}
    for c in filter(str.isalpha, map(chr, range(sys.maxunicode + 1))):
        word = unicodedata.name(c, "OTHER").split(" ", 1)[0].split("-", 1)[0]
        script[ord(c)] = number.setdefault(word, len(number) + 1)
        if len(c.lower()) == 1:
            lower[ord(c)] = ord(c.lower())
    return script, lower, script > 0


_SCRIPT, _LOWER, _ALPHA = _alphabet()
N_SCRIPTS = int(_SCRIPT.max()) + 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Grams:
    """Words of a chunk of texts and the hashed character runs of each."""

    def __init__(self, texts: list[str]) -> None:
        cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _ALPHA[cps]
        edge = np.flatnonzero(np.diff(alpha, prepend=False))
        self.start, end = edge[::2], edge[1::2]
        self.end = end
        self.length = end - self.start
        self.offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        at = np.flatnonzero(alpha)
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1])) if len(self.length) else self.length
        low = np.where(alpha, _LOWER[cps], 1).astype(np.uint64)  # a boundary looks the same whatever it is
        pad = np.concatenate((np.array([1], np.uint64), low, np.array([1], np.uint64)))
        a, b, c = pad[at], pad[at + 1], pad[at + 2]
        self.grams = np.stack([(mix(h) >> np.uint64(64 - BITS)).astype(np.int32) for h in (b * _A + _C, a * _A + b * _B, a * _A + b * _B + c * _C)], 1)
        last = low[np.maximum(self.end - 1, 0)] * _A + _B  # the ending closes the last pair
        self.ending = (mix(last) >> np.uint64(64 - BITS)).astype(np.int32)
        self.script = _SCRIPT[cps[self.start]]


class Model:
    """Weights per hashed run and language, and the scripts that each language was taught in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * len(counts)) if langs else counts
        logs = np.log(p) if langs else counts
        self.logs = (logs - logs.mean(1, keepdims=True)).astype(np.float32) if langs else counts
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True)) if langs else scripts
        taught = (share >= 0.01).T if langs else scripts  # by script, then language
        self.mask = np.where(taught | ~taught.any(1, keepdims=True), 0.0, -1e6).astype(np.float32) if langs else scripts

    def words(self, g: Grams) -> np.ndarray:
        """Scores of every word by language: 0 for the best, the others below."""
        each = self.logs[g.grams[:, 0]] + self.logs[g.grams[:, 1]] + self.logs[g.grams[:, 2]]
        s = np.add.reduceat(each, g.first, axis=0) + self.logs[g.ending]
        s = s / 3 + self.mask[g.script]
        return np.maximum(s - s.max(1, keepdims=True), np.where(self.mask[g.script] < 0, -1e6, -CLIP))


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best labels of each sequence, whose steps run side by side for all sequences.

    Sequences are sorted by length, so those still running are always the first ones.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(len(s), np.int16) for s in scores]
    at = 0
    while at < len(order):
        # groups of similar length keep the padded table small
        group = order[at : at + 256]
        group = [i for i in group if len(scores[i]) * 4 >= len(scores[group[0]]) or len(scores[group[0]]) < 64]
        at += len(group)
        longest = len(scores[group[0]])
        if not longest:
            continue
        langs = scores[group[0]].shape[1]
        lengths = np.array([len(scores[i]) for i in group])
        running = np.searchsorted(-lengths, -np.arange(longest), side="left")
        table = np.zeros((longest, len(group), langs), np.float32)
        for j, i in enumerate(group):
            table[: lengths[j], j] = scores[i]
        back = np.zeros((longest, len(group), langs), np.int16)
        total = table[0].copy()
        final = np.zeros((len(group), langs), np.float32)
        stay = np.arange(langs, dtype=np.int16)
        done = len(group)
        for t in range(1, longest):
            n = running[t]
            if n < done:
                final[n:done] = total[n:done]
                done = n
            best = total[:n].argmax(1)
            jump = np.take_along_axis(total[:n], best[:, None], 1) - switch
            go = jump > total[:n]
            back[t, :n] = np.where(go, best[:, None], stay)
            total = np.where(go, jump, total[:n]) + table[t, :n]
        final[:done] = total[:done]
        label = final.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = running[t]
            for_t = label[:n]
            table[t, :n, 0] = for_t
            label[:n] = back[t, np.arange(n), for_t] if t else for_t
        for j, i in enumerate(group):
            out[i] = table[: lengths[j], j, 0].astype(np.int16)
    return out


def train(docs: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Counts of character runs and scripts by language over taught rows.

    About ``sample`` rows of each language teach, chosen by a hash of the id and the text, so that
    rare languages are learned at every size; only fixed-size counts of each language come to the
    driver.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(usable) if usable is not None else rows
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in rows.groupBy("lang").count().collect()}  # one row a language
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang")) if share else F.lit(0.0)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("teach")), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                c = found.setdefault(lang, [np.zeros(1 << BITS), np.zeros(N_SCRIPTS)])
                for _, blobs in chunks([t.encode("utf-8", "surrogatepass") for t in part["text"]]):
                    g = Grams([b.decode("utf-8", "surrogatepass") for b in blobs])
                    c[0] += np.bincount(g.grams.ravel(), minlength=1 << BITS) + np.bincount(g.ending, minlength=1 << BITS)
                    c[1] += np.bincount(g.script, minlength=N_SCRIPTS)
        for lang, (c, s) in found.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "k": at, "n": c[at]})
            yield pd.DataFrame({"lang": lang, "k": -1 - np.arange(len(s)), "n": s})

    counted = rows.where(u < rate).select("lang", "text").mapInPandas(run, "lang string, k int, n double").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    counts, scripts = np.zeros((1 << BITS, len(langs))), np.zeros((len(langs), N_SCRIPTS))
    for j, lang in enumerate(langs):
        part = counted[counted["lang"] == lang]
        grams, marks = part[part["k"] >= 0], part[part["k"] < 0]
        counts[grams["k"], j] = grams["n"]
        scripts[j, -1 - marks["k"].to_numpy()] = marks["n"]
    return Model(langs, counts, scripts)


def _between_words(text: str) -> Iterator[tuple[int, str]]:
    """A text in pieces of about ``PIECE`` characters that part no word, each with its offset."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and _ALPHA[ord(text[end - 1])]:
            end -= 1
        if end == at:  # one word: it goes on to its end
            end = at + PIECE
            while end < len(text) and _ALPHA[ord(text[end])]:
                end += 1
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def label(texts: list[str | None], model: Model, switch: float = SWITCH) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, share of letters and spans (begin, end, language; code points) of each text."""
    own: list[tuple[int, int]] = []  # text and offset of each piece
    blobs: list[bytes] = []
    for i, t in enumerate(texts):
        for at, x in _between_words(t or ""):
            own.append((i, at))
            blobs.append(x.encode("utf-8", "surrogatepass"))
    left = np.bincount([i for i, _ in own], minlength=len(texts))  # pieces that are still to come
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in texts]
    found: list[tuple[str, float, list[tuple[int, int, str]]]] = [("und", 0.0, []) for _ in texts]
    for begin, part in chunks(blobs) if model.langs else ():
        g = Grams([b.decode("utf-8", "surrogatepass") for b in part])
        bounds = np.searchsorted(g.doc, np.arange(len(part) + 1)).tolist()
        s = model.words(g) if len(g.start) else None
        done = []
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            i, at = own[begin + d]
            if a < b:
                shift = at - g.offset[d]
                parts[i].append((s[a:b], g.start[a:b] + shift, g.end[a:b] + shift))
            left[i] -= 1
            if not left[i] and parts[i]:
                done.append(i)
        words = [tuple(np.concatenate(x) for x in zip(*parts[i])) for i in done]
        for i, labels, (_, start, end) in zip(done, viterbi([w[0] for w in words], switch), words):
            n = np.bincount(labels, end - start, len(model.langs))
            turn = np.flatnonzero(np.diff(labels, prepend=-1))
            close = np.append(turn[1:], len(labels)) - 1
            top = int(n.argmax())
            found[i] = (model.langs[top], float(n[top] / n.sum()), [(int(start[x]), int(end[y]), model.langs[labels[x]]) for x, y in zip(turn, close)])
            parts[i] = []
    yield from found


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers per language

    @F.pandas_udf("lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = list(label(texts.tolist(), shared.value, switch))
        return pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[{"begin": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows]})

    return docs.withColumn("_language", run("text")).select(*[c for c in docs.columns if c not in ("lang_pred", "score", "spans")], "_language.*")
