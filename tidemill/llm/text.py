"""Columnar text kernel: words, n-grams and 64-bit hashes of whole Arrow string batches with numpy.

No Python loop runs over documents or words. A batch is cut at document borders into
slices of about ``SLICE_BYTES`` so that the working memory stays bounded (a single text
longer than that forms its own slice). Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (wraps modulo 2**64)."""
    with np.errstate(over="ignore"):
        return _splitmix(x.astype(np.uint64) + _U(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x5851F42D4C957F2D))
_BYTE_LOWER = _BYTE[_LOWER]
_RADIX = _U(0xD6E8FEB86659FD93)
_POWERS = np.ones(0, np.uint64)
#: Powers that are kept; longer tokens get theirs each time.
_KEPT_POWERS = 1 << 16

#: ASCII white space: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Byte classes: 0 white space, 1 letter (and any non-ASCII byte), 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) >= n:
        return _POWERS
    p = np.full(max(256, 1 << (n - 1).bit_length()), _RADIX, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        p = np.multiply.accumulate(p)
    if n <= _KEPT_POWERS:
        _POWERS = p
    return p


@dataclass
class Slice:
    """Texts ``first .. first + n`` of a batch: their bytes and each text's bounds in them."""

    first: int
    buf: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.begin)


@dataclass
class Tokens:
    """Tokens in text order: document index within the slice, byte bounds, hash."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n).astype(np.int64)


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string array into slices of at most ``limit`` bytes (or one text)."""
    done = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if pa.types.is_null(chunk.type):
            chunk = chunk.cast(pa.string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        if not n:
            continue
        wide = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        off = np.frombuffer(chunk.buffers()[1], wide)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = chunk.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield Slice(done + i, raw[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i])
            i = j
        done += n


def _owner(s: Slice, start: np.ndarray) -> np.ndarray:
    # empty texts share a begin with their successor, so the last text that begins here owns the byte
    return (np.searchsorted(s.begin, start, "right") - 1).astype(np.int32)


def _bounds(s: Slice, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero kind inside one text."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[s.begin] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    full = kind[start] != 0
    return start[full], end[full]


def hash_spans(buf: np.ndarray, start: np.ndarray, size: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each (non-empty, ascending, disjoint) byte span; ASCII case folded if ``lower``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = pos + np.repeat(start, size)
    with np.errstate(over="ignore"):
        x = (_BYTE_LOWER if lower else _BYTE)[buf[at]] * _powers(int(size.max()))[pos]
        return mix(np.add.reduceat(x, first) + size.astype(np.uint64))


def words(s: Slice) -> Tokens:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased for the hash."""
    start, end = _bounds(s, (~SPACE[s.buf]).view(np.uint8))
    return Tokens(_owner(s, start), start, end - start, hash_spans(s.buf, start, end - start))


def runs(s: Slice) -> Tokens:
    """Runs of letters, of digits and of other marks; white space separates."""
    start, end = _bounds(s, KIND[s.buf])
    return Tokens(_owner(s, start), start, end - start, hash_spans(s.buf, start, end - start))


def lines(s: Slice) -> Tokens:
    """Non-empty stretches between line feeds, hashed with their case."""
    start, end = _bounds(s, (s.buf != 10).view(np.uint8))
    return Tokens(_owner(s, start), start, end - start, hash_spans(s.buf, start, end - start, lower=False))


def ngrams(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``n`` words of one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    with np.errstate(over="ignore"):
        g = np.zeros(len(at), np.uint64)
        for k in range(n):
            g = (g + h[at + k]) * _RADIX
    return at, mix(g + _U(n))


def distinct_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, hash) pairs, ordered by both."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[new], x[new]


def sum_per_doc(doc: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=v, minlength=n)
