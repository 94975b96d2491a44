"""URL filter: a bit-parallel automaton for all glob rules at once.

Every rule is a glob over the canonical URL, which is ``.host``, a separator byte and the path:
``*`` stands for any text, ``?`` for any one byte. The positions of all rules are packed into the bits of one
multiword Shift-And state; a position behind a ``*`` keeps its bit on every byte. All URLs of a
batch step together, one byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_U = np.uint64
SEPARATOR = b"\x01"

#: (host, path, verdict) rules; the longest that fits decides.
PATH_RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Globs over host and path that block where no path rule fits.
BLOCK_GLOBS: tuple[tuple[str, str], ...] = (
    ("*spam*", "*"),
    ("*cheap-*", "*"),
    ("*casino*", "*"),
    ("*pills*", "*"),
    ("*adult*", "*"),
    ("*", "*/ads/*"),
    ("*", "*/login*"),
    ("*", "*.exe"),
)


class ShiftAnd:
    """Compiled byte globs; ``match`` tells for each text which of them cover it whole."""

    def __init__(self, globs: list[bytes]) -> None:
        starts, ends, letters, loops = [], [], [], []
        n = 0
        for g in globs:
            starts.append(n)
            # one bit for "nothing read yet", then one for each letter
            letters.append(None)
            for c in g:
                if c == 42:
                    loops.append(len(letters) - 1)
                else:
                    letters.append(c)
            n = len(letters)
            ends.append(n - 1)
        self.words = max(1, -(-n // 64))
        self.table = np.zeros((256, self.words), np.uint64)
        self.first, self.loop = self._mask(starts), self._mask(loops)
        for i, c in enumerate(letters):
            if c == 63:
                self.table[:] |= self._mask([i])
            elif c is not None:
                self.table[c] |= self._mask([i])
        self.ends = np.array(ends, np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        m = np.zeros(self.words, np.uint64)
        for b in bits:
            m[b // 64] |= _U(1) << _U(b % 64)
        return m

    def match(self, buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Boolean, texts by globs."""
        state = np.broadcast_to(self.first, (len(begin), self.words)).copy()
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for i, n in enumerate(live):  # the n longest texts have a byte i
            rows = order[:n]
            d = state[rows]
            moved = d << _U(1)
            moved[:, 1:] |= d[:, :-1] >> _U(63)
            state[rows] = (moved & self.table[buf[begin[rows] + i]]) | (d & self.loop)
        return (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & _U(1) == 1


def _escape(s: str) -> bytes:
    return s.encode().replace(b"\x01", b"\x02")


@dataclass(frozen=True)
class UrlRules:
    """Path rules and blocking globs as one automaton."""

    path_rules: tuple[tuple[str, str, str], ...] = PATH_RULES
    block_globs: tuple[tuple[str, str], ...] = BLOCK_GLOBS

    def compiled(self) -> ShiftAnd:
        globs = [b"*." + _escape(h) + SEPARATOR + _escape(p) + b"*" for h, p, _ in self.path_rules]
        globs += [_escape(h) + SEPARATOR + _escape(p) for h, p in self.block_globs]
        return ShiftAnd(globs)

    def judge(self, automaton: ShiftAnd, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """(rule or null, verdict) of each URL: the longest fitting path rule's, else block if a glob fits, else allow."""
        raw = [b"." + _escape(h) + SEPARATOR + _escape(p) for h, p in zip(hosts, paths, strict=True)]
        size = np.array([len(x) for x in raw], np.int64)
        hit = automaton.match(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
        k = len(self.path_rules)
        length = np.array([len(h + p) for h, p, _ in self.path_rules])
        rank = np.where(hit[:, :k], length, -1) if k else np.full((len(raw), 1), -1)
        which = np.where(rank.max(axis=1) >= 0, rank.argmax(axis=1), -1)
        names, verdicts = [h + p for h, p, _ in self.path_rules], [v for _, _, v in self.path_rules]
        glob = hit[:, k:].any(axis=1)
        return [names[i] if i >= 0 else None for i in which], [verdicts[i] if i >= 0 else "block" if g else "allow" for i, g in zip(which, glob, strict=True)]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is no ``://``."""
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: UrlRules | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A null url, or one without ``://``, has an empty host and path, which fit no rule here, and is
    allowed. Repeated rows stay repeated, a null page_id stays null, other columns are not read.
    """
    rules = rules or UrlRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = rules.compiled()
        for b in batches:
            rule, verdict = rules.judge(automaton, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
