"""Token ids of whole Arrow batches through a cache of text units.

A unit is a stretch of text that a tokenizer encodes alike wherever it stands; the caller gives the
units' bounds. Each task encodes a unit when it first meets it and then looks its ids up by its
64-bit hash, all units of a slice at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import text as T


class UnitCache:
    """Ids by unit hash in flat arrays. Before they would take more than ``limit`` bytes the newer half goes: what came first is met most."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 24 << 20) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.start.nbytes + self.size.nbytes + self.ids.nbytes

    def clear(self) -> None:
        self.keys, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def shrink(self) -> None:
        if len(self.start) > 1:
            cut = int(np.partition(self.start, len(self.start) // 2)[len(self.start) // 2])
            old = self.start < cut
            self.keys, self.start, self.size, self.ids = self.keys[old], self.start[old], self.size[old], self.ids[:cut].copy()

    def lookup(self, s: T.Slice, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each unit)."""
        h = T.hash_spans(s.buf, start, size, lower=False)
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        if self.nbytes + 32 * len(keys) > self.limit:
            self.shrink()
        if self.nbytes + 32 * len(keys) > self.limit:
            self.clear()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = s.buf.tobytes()
            got = self.encode([raw[start[i] : start[i] + size[i]].decode("utf-8", "replace") for i in first[new]])
            n = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter((x for y in got for x in y), np.int32, int(n.sum()))
            begin = len(self.ids) + np.cumsum(n, dtype=np.int64) - n
            put = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, put, keys[new])
            self.start, self.size = np.insert(self.start, put, begin), np.insert(self.size, put, n)
            self.ids = np.concatenate([self.ids, flat])
            where = np.searchsorted(self.keys, keys)
        where = where[at]
        return spread(self.ids, self.start[where], self.size[where]), self.size[where].astype(np.int64)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave for ``key``; a Python worker that runs several tasks keeps the last one."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + size[0]], flat[start[1] : ...], ... as one array."""
    size = size.astype(np.int64)
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def byte_level_units(s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, size) of the units of a byte-level BPE with the usual word pattern.

    That pattern lets a token span white space and other text only as one leading space, so a unit
    is a run without white space with the space before it; of the white space that stays, the last
    character before other text is a unit of its own.
    """
    space = T.SPACE[s.buf]
    ws, we = T._bounds(s, (~space).view(np.uint8))
    gs, ge = T._bounds(s, space.view(np.uint8))
    doc_of = T._owner(s, ws)
    led = ws > s.begin[doc_of] if len(ws) else np.zeros(0, bool)
    led[led] = s.buf[ws[led] - 1] == 32
    gap_doc = T._owner(s, gs)
    inner = ge < s.end[gap_doc] if len(gs) else np.zeros(0, bool)
    last_space = s.buf[ge - 1] == 32 if len(ge) else np.zeros(0, bool)
    own_last = inner & ~last_space
    head_end = np.where(inner, ge - 1, ge)
    head = head_end > gs
    start = np.concatenate([ws - led, gs[head], ge[own_last] - 1])
    size = np.concatenate([we - ws + led, head_end[head] - gs[head], np.ones(int(own_last.sum()), np.int64)])
    order = np.argsort(start, kind="stable")
    start, size = start[order], size[order]
    return T._owner(s, start), start, size


def has_wide_space(s: T.Slice) -> np.ndarray:
    """Whether each text has white space beyond ASCII, or ``<|``, with which a special token could begin."""
    b = s.buf
    flag = np.zeros(len(b) + 1, np.int64)
    if len(b) > 1:
        flag[1 : len(b)] |= ((b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))) | ((b[:-1] == 0x3C) & (b[1:] == 0x7C))
    if len(b) > 2:
        x, y, z = b[:-2], b[1:-1], b[2:]
        wide = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        wide |= ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        flag[2 : len(b)] |= wide
    c = np.concatenate([[0], np.cumsum(flag[: len(b)])])
    return c[s.end] > c[s.begin]
