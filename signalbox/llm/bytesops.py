"""Whole batches of texts as byte arrays: words, rolling hashes and hashed shingles, vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One odd random number per byte value, drawn by a fixed seed so that every task hashes alike.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the argument is left as it is."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, U(base), np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any slices of a byte array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        up, self._down = _powers(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64) * U(0xD1342543DE82EF95))

    def grams(self, q: int) -> np.ndarray:
        """The hash of the q bytes from each position on."""
        n = len(self._sums) - q
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[q:] - self._sums[:n]) * self._down[:n])


def text_chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; nulls read as empty.

    A longer text makes a chunk of its own, so memory is bounded by the longest text.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes not marked in `between` (0x20 and 0x09-0x0D)."""
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = between[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space[1:-1] & (space[:-2] | edge[:-1]))
    end = np.flatnonzero(~space[1:-1] & (space[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of k words, as 64-bit hashes, of every text: (hashes, sizes, words).

    A text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    n = len(offsets) - 1
    buf = lowered(buf)
    start, end, doc = word_spans(buf, offsets)
    words = np.bincount(doc, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words)])
    hashes = Rolling(buf).of(start, end) if len(start) else np.zeros(0, np.uint64)
    salts = mix(np.arange(1, k + 1, dtype=np.uint64) * U(_BASE)) | U(1)
    runs = max(0, len(hashes) - k + 1)
    grams = np.zeros(runs, np.uint64)
    for j in range(k):
        grams += hashes[j : j + runs] * salts[j]
    grams = mix(grams)
    sets, sizes = [], np.zeros(n, np.int64)
    for d in range(n):
        if words[d] >= k:
            own = np.unique(grams[first[d] : first[d] + words[d] - k + 1])
        elif words[d]:
            part = hashes[first[d] : first[d + 1]]
            own = mix((part * salts[: len(part)]).sum(dtype=np.uint64, keepdims=True) + U(int(words[d]) * 0x51ED2701))
        else:
            continue
        sets.append(own)
        sizes[d] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes, words
