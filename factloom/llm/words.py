"""Words of many texts at once: one pass of numpy over their bytes instead of a loop per word.

Runs inside Spark tasks on one Arrow batch at a time; texts are cut into chunks of about
``CHUNK`` bytes, and a longer text makes a chunk of its own, whose bytes are hashed ``WINDOW`` at
a time. So the arrays per byte stay small whatever the batch holds, and what grows with a long
text is a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

CHUNK = 1 << 20
#: Bytes that are hashed at once; their sums stay in a core's cache.
WINDOW = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    """The powers of an odd number modulo 2**64, up to those of a window and its end."""
    out = np.full(WINDOW + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words of a chunk of texts, in order."""

    hash: np.ndarray  # uint64
    doc: np.ndarray  # index of the text within the chunk
    line: np.ndarray  # index of the line over the whole chunk; every text starts a new line
    start: np.ndarray  # byte offset within the chunk
    end: np.ndarray
    first_line: np.ndarray  # of each text; one more at the end


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of bytes; equal runs have equal hashes wherever they stand.

    The difference of two prefix sums is a run's polynomial times the power of its place, which
    an inverse power takes away; a run that goes on in the next window adds up.
    """
    out = np.zeros(len(start), np.uint64)
    for a in range(0, len(buf), WINDOW):
        b = min(a + WINDOW, len(buf))
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        if i == j:
            continue
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(np.multiply(buf[a:b], _POW[: b - a], dtype=np.uint64), out=sums[1:])
        s, e = np.maximum(start[i:j] - a, 0), np.minimum(end[i:j], b) - a
        part = (sums[e] - sums[s]) * _INVERSE[s]
        if start[i] < a:
            part[:1] *= np.uint64(pow(_BASE, a - int(start[i]), 1 << 64))
        out[i:j] += part
    return out


def split_words(blobs: list[bytes]) -> Words:
    """Words are runs of bytes other than white space; equal words have equal hashes."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))
    edge = np.flatnonzero(np.diff((buf != 32) & (buf - 9 > 4), prepend=False))  # 9 to 13 and 32 are white space
    start, end = edge[::2], edge[1::2]
    newline = np.flatnonzero(buf == 10)
    own = lambda bounds: np.repeat(np.arange(len(bounds)), np.diff(np.searchsorted(start, bounds), prepend=0))
    value = hashes(buf, start, end) + (end - start).astype(np.uint64)  # zero bytes count by the length
    return Words(mix(value), own(offset[1:]), own(newline), start, end, np.searchsorted(newline, offset))


def chunks(blobs: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes with the index of their first text."""
    begin, total = 0, 0
    for i, blob in enumerate(blobs):
        if total and total + len(blob) > size:
            yield begin, blobs[begin:i]
            begin, total = i, 0
        total += len(blob) + 1
    if begin < len(blobs):
        yield begin, blobs[begin:]


def pieces(text: str, size: int, ends: str) -> Iterator[tuple[int, str]]:
    """A text in pieces of about ``size`` characters, each with its offset.

    A piece ends after the last character of ``ends`` in it, and goes on to the next one where it holds none.
    """
    at = 0
    while len(text) - at > size:
        last = max(text.rfind(c, at, at + size) for c in ends)
        if last < 0:
            last = min((x for c in ends if (x := text.find(c, at + size)) >= 0), default=len(text) - 1)
        yield at, text[at : last + 1]
        at = last + 1
    if at < len(text) or not at:
        yield at, text[at:]
