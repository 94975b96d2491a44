"""Hierarchical Pitman-Yor language model over words, three words wide.

Every pair of previous words has a restaurant of its own; its parent, which it shares with all pairs that
end alike, is the restaurant of the last word alone, and the parent of those is one root, whose base
measure is uniform over the V known words and one unknown. A word's customers in a restaurant of
pairs are its occurrences there; every table is a customer of the parent.

Seating is sampled by blocked Gibbs sweeps: all customers of one word in one restaurant leave and are
seated anew, one after the other, given the other words' tables from the sweep before. Discounts come
from the numbers of words seen once and twice, concentrations from the expected numbers of
new tables given the seating. Texts are scored with the predictive probabilities averaged over two samples.

Everything covers all training texts. Restaurants are dealt by their last word to parts, whose
number follows the size of the texts, so that a pair's restaurant and its parent lie together. The restaurants of
frequent last words are dealt by both words; their parents and the root are seated by word, in groups of words,
from what the parts report, and the parts are told the probabilities of the words they hold. Only
totals of the root and of the frequent words' restaurants reach the driver. Every token is sent
once: a part counts what it gets and keeps, by block of texts, which of its entries stand in which
document, so that it scores each distinct entry once. Words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from . import text as T

_U = np.uint64
#: Bytes of text to a part, and tokens that a task holds before it passes them on.
PART_BYTES = 12 << 20
BLOCK_TOKENS = 1_200_000
#: Words that have a short number for sending, and the share of a block's tokens that makes a word one of them.
COMMON, COMMON_SHARE = 131_072, 1.5e-6
#: Sweeps that are thrown away, and kept.
BURN_IN, KEPT = 1, 2
#: The token that ends a text; it stands for what comes before a text, too.
END = T.mix(np.array([0xE0D], np.uint64))[0]


def token_stream(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(doc, word hash) of all tokens of a slice, each text's end included, in text order."""
    w = T.words(s)
    doc = np.concatenate([w.doc, np.arange(s.n, dtype=np.int32)])
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate([w.hash, np.full(s.n, END)])[order]


def scaled(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether present) of each wanted value among ascending keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """An array without its type, compressed behind its size, first bytes of all values first."""
    x = np.ascontiguousarray(x).ravel()
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_CODEC.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their distances, which are short where there are many."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def least_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def unpack_index(b: bytes, n: int) -> np.ndarray:
    return unpack(b, least_type(n)).astype(np.int32)


def joined(some: list[np.ndarray]) -> np.ndarray:
    """The arrays of ``some`` as one; the list is emptied, so that they can be let go."""
    out = np.concatenate(some)
    some.clear()
    return out


# --- where restaurants lie ---


@dataclass(frozen=True)
class Layout:
    """The number of parts, the words (ascending) whose restaurants of pairs are dealt by both words, and words with short numbers."""

    parts: int
    frequent: np.ndarray
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The short number of each word, -1 without one."""
        order = np.argsort(self.common)
        at, known = lookup(self.common[order], words)
        return np.where(known, order[at] if len(order) else -1, -1)

    def part(self, words: np.ndarray, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The part of each pair of words, by index into ``words``."""
        out = scaled(T.mix(words), self.parts).astype(np.int32)[one]
        split = np.flatnonzero(lookup(self.frequent, words)[1][one])
        out[split] = scaled(T.mix(words[one[split]] ^ T.mix(words)[two[split]]), self.parts)
        return out


def plan_layout(texts: DataFrame, *, part_bytes: int = PART_BYTES, share: float = 0.25) -> Layout:
    """Parts of about ``part_bytes`` of text; frequent is a word with at least ``share`` of a part's tokens.

    A word of that share has half of it in some block of tokens at least, so blocks only report words
    above half of it, and there are at most 2 / share words a part. Blocks also report words with ``COMMON_SHARE`` of their tokens, two at least; the
    most frequent ``COMMON`` of them get short numbers. All this only says where things lie and how they are sent.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // part_bytes))
    least = share / parts / 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            words, n = np.unique(h, return_counts=True)
            often = n >= min(least * len(h), max(2, COMMON_SHARE * len(h)))
            words, n = np.append(words[often], END).view(np.int64), np.append(n[often], len(h))
            total = np.arange(len(n)) == len(n) - 1
            return pa.RecordBatch.from_arrays([pa.array(words, mask=total), pa.array(n)], ["h", "n"])

        for b in batches:
            for s in T.slices(b.column(0)):
                held.append(token_stream(s)[1])
                if sum(map(len, held)) >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    counts = texts.select("text").mapInArrow(base.frugal(emit), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = base.stored(counts)
    total = (counts.where("h IS NULL").first() or {"n": 0})["n"]
    found = counts.where(F.col("h").isNotNull() & (F.col("n") >= least * total)).select("h").collect()
    common = counts.where("h IS NOT NULL").orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)
    frequent = np.array([r.h for r in found], np.int64).view(np.uint64)
    return Layout(int(parts), np.sort(frequent), common)


# --- counts ---


@dataclass(frozen=True)
class Counts:
    """One part: its words (ascending), which of them follow a context (``told``, by index) and not only make one, occurrences ``c`` of
    (two, one, word) in order of (one, two, word), all by index into the words, and the (one, word) pairs of frequent words and the entries
    that are asked for though they did not occur."""

    words: np.ndarray
    told: np.ndarray
    two: np.ndarray
    one: np.ndarray
    w: np.ndarray
    c: np.ndarray
    asked_one: np.ndarray
    asked_w: np.ndarray
    new_two: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    new_one: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    new_w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def blobs(self) -> list[bytes]:
        kind = least_type(len(self.words))
        told, two, one, w, *rest = (pack(getattr(self, k).astype(kind)) for k in _INDICES)
        return [pack_sorted(self.words), told, two, one, w, pack(self.c.astype(np.uint32)), *rest]

    @staticmethod
    def read(row: dict) -> Counts:
        words = unpack_sorted(row["words"])
        index = {k: unpack_index(row[k], len(words)) for k in _INDICES if k in row}
        return Counts(words, c=unpack(row["c"], np.uint32), **index)


_INDICES = ("told", "two", "one", "w", "asked_one", "asked_w", "new_two", "new_one", "new_w")
_SEATED = "part int, words binary, told binary, two binary, one binary, w binary, c binary, asked_one binary, asked_w binary"
#: What only scoring reads: the entries that did not occur, then :class:`Asked`.
_COUNTS = f"{_SEATED}, new_two binary, new_one binary, new_w binary, blocks binary, entries binary, times binary, doc binary, head_size binary, heads binary"


@dataclass(frozen=True)
class Asked:
    """What a part was sent by each block of texts, in the order of the entries (those of ``Counts``, then its new ones)."""

    blocks: np.ndarray
    #: Distances of the ascending numbers that are the place of the block times the number of entries, plus the entry.
    steps: np.ndarray
    #: How often the entry stands in the block, and in which of its documents, one after another.
    times: np.ndarray
    doc: np.ndarray
    #: Ids and numbers of tokens of some blocks' documents as an Arrow stream; empty for the other blocks.
    heads: list[bytes]

    @staticmethod
    def sorted(blocks: np.ndarray, size: np.ndarray, entry: np.ndarray, n: int, times: np.ndarray, doc: np.ndarray, heads: list[bytes]) -> Asked:
        """From entries (below ``n``) in any order inside their blocks, which have ``size`` of them, one at least."""
        return Asked.gathered([(blocks, size, entry, times, doc, heads)], n)

    @staticmethod
    def gathered(some: Iterable[tuple], n: int) -> Asked:
        """The same from some blocks after others, of which only those at hand take working memory."""
        blocks, steps, often, docs, heads = [], [], [], [], []
        before = done = 0
        for block, size, entry, times, doc, head in some:
            key = np.repeat(np.arange(done, done + len(block)), size) * n + entry
            order = np.argsort(key)
            key, times = key[order], times.astype(np.int64)
            start, times = (np.cumsum(times) - times)[order], times[order]
            token = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(len(doc))
            blocks.append(block)
            steps.append(np.diff(key, prepend=before).astype(np.uint32))
            often.append(times.astype(np.uint32))
            docs.append(doc[token])
            heads += head
            before, done = key[-1], done + len(block)
        return Asked(joined(blocks), joined(steps), joined(often), joined(docs), heads)

    def blobs(self) -> list[bytes]:
        size = np.array([len(x) for x in self.heads], np.int64)
        return [pack(self.blocks), pack(self.steps), pack(self.times), pack(self.doc), pack(size), b"".join(self.heads)]

    @staticmethod
    def read(row: dict) -> Asked:
        times = unpack(row["times"], np.uint32)
        end = np.cumsum(unpack(row["head_size"], np.int64))
        heads = [row["heads"][i:j] for i, j in zip([0, *end[:-1]], end, strict=True)]
        return Asked(unpack(row["blocks"], np.int64), unpack(row["entries"], np.uint32), times, unpack_docs(row["doc"], int(times.sum(dtype=np.int64))), heads)

    def each(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, its entries, how often each, documents of its tokens)."""
        entries = np.cumsum(self.steps, dtype=np.int64)
        at = np.searchsorted(entries, np.arange(len(self.blocks) + 1) * n)
        token = np.concatenate([[0], np.cumsum(np.add.reduceat(self.times, at[:-1], dtype=np.int64))])
        for k, block in enumerate(self.blocks.tolist()):
            i, j = at[k], at[k + 1]
            yield block, entries[i:j] - k * n, self.times[i:j], self.doc[token[k] : token[k + 1]]


def unpack_docs(b: bytes, tokens: int) -> np.ndarray:
    return unpack(b, np.uint16 if int.from_bytes(b[:8], "little") == 2 * tokens else np.uint32)


def _columns(rows: list[tuple], schema: str) -> list[pa.Array]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return [pa.array(c, k) for c, k in zip(cols, types, strict=True)]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def changes(x: np.ndarray) -> np.ndarray:
    """Whether each value of an ordered array is the first of its kind."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def sorted_entries(n: int, most: int, *cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the columns, first position of each distinct row); the first column is below ``most``, the others below ``n``."""

    def ordered(cols: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            key *= n
            key += c
        order = np.argsort(key)
        return order, changes(key[order])

    if most * n ** (len(cols) - 1) < 1 << 63:  # one number for a row
        order, change = ordered(cols)
        return order, np.flatnonzero(change)
    if n ** (len(cols) - 1) < 1 << 63:  # one for all but the first column, by which they are dealt then
        order, change = ordered(cols[1:])
        rank = np.cumsum(change)
        dealt = np.argsort(cols[0][order].astype(least_type(most)), kind="stable")
        order, rank = order[dealt], rank[dealt]
        return order, np.flatnonzero(changes(rank) | changes(cols[0][order]))
    order = np.lexsort(cols[::-1])
    change = np.zeros(len(order), bool)
    for c in cols:
        change |= changes(c[order])
    return order, np.flatnonzero(change)


class Block:
    """Tokens of consecutive texts that a task sends on together, sorted by part and context."""

    def __init__(self, layout: Layout, h: np.ndarray, first: np.ndarray) -> None:
        """``first``: whether a token is the first of its text."""
        words, r = np.unique(np.append(h, END), return_inverse=True)
        # in order of the numbers by which they are sent, so that what is sent ascends
        number = layout.numbers(words)
        order = np.argsort(np.where(number < 0, len(layout.common) + np.arange(len(words)), number))
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        words, r = words[order], place[r]
        end, r = r[-1:], r[:-1]
        one, two = np.concatenate([end, r[:-1]]), np.concatenate([end, end, r[:-2]])[: len(r)]
        one[first], two[first] = end, end
        self.words, self.end, self.r, self.one, self.two = words, end[0], r, one, two
        self.part = layout.part(words, two, one)
        self.number, self.common = number[order], len(layout.common)

    def rows(self, layout: Layout, two: np.ndarray, one: np.ndarray, r: np.ndarray) -> Iterator[tuple]:
        """(part, words without a short number, two, one, w, positions of its tokens by entry, first position of each entry) for each part.

        Words go by their short numbers, and those without one by their place among the part's behind them.
        """
        n = len(self.words)
        order, at = sorted_entries(n, layout.parts, self.part, one, two, r)
        cut = np.searchsorted(self.part[order][at], np.arange(layout.parts + 1))
        bounds = np.append(at, len(order))
        mark, places = np.zeros(n, bool), np.zeros(n, np.int64)
        for p in np.flatnonzero(np.diff(cut)):
            i, j = cut[p], cut[p + 1]
            e = order[at[i:j]]
            used = np.concatenate([two[e], one[e], r[e]])
            index = self.number[used]
            rare = np.flatnonzero(index < 0)
            mark[used[rare]] = True
            ids = np.flatnonzero(mark)
            mark[ids] = False
            places[ids] = self.common + np.arange(len(ids))
            index[rare] = places[used[rare]]
            index = index.astype(least_type(self.common + len(ids))).reshape(3, -1)
            yield int(p), self.words[ids], *index, order[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]


def pack_ascending(one: np.ndarray, two: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Columns of rows in order, each but the last by its distances where those before it stay the same."""
    step = two.copy()
    step[1:] -= two[:-1] * (one[1:] == one[:-1])
    return pack(np.diff(one, prepend=one.dtype.type(0))), pack(step), pack(w)


def unpack_ascending(one: bytes, two: bytes, w: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, two, w) of :func:`pack_ascending`, below ``n``."""
    kind = least_type(n)
    first, step = np.cumsum(unpack(one, kind), dtype=kind).astype(np.int64), unpack(two, kind).astype(np.int64)
    total = np.cumsum(step)
    start = np.flatnonzero(changes(first))
    before = np.concatenate([[0], total])[start]
    return first, total - np.repeat(before, np.diff(np.append(start, len(first)))), unpack_index(w, n)


def _blocks(batches: Iterator[pa.RecordBatch], layout: Layout, most: int) -> Iterator[tuple[Block, np.ndarray, list[pa.RecordBatch]]]:
    """(block of at least ``most`` tokens, document of each token, the documents' rows); texts are in the last column of the batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows: list[pa.RecordBatch] = []
    docs = tokens = 0

    def made():
        doc, h = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        return Block(layout, h, first), doc, list(rows)

    for b in batches:
        for s in T.slices(b.column(b.num_columns - 1)):
            doc, h = token_stream(s)
            held.append((doc + np.int32(docs), h))
            rows.append(b.slice(s.first, s.n).select(list(range(b.num_columns - 1))))
            docs, tokens = docs + s.n, tokens + len(h)
            if tokens >= most:
                yield made()
                rows.clear()
                docs = tokens = 0
    if held:
        yield made()


#: Tokens whose documents are put in order together when a part's blocks are merged.
MERGED_TOKENS = 1 << 18


def merged_counts(t: pa.Table, layout: Layout) -> pa.Table:
    """What all blocks sent to one part, as one row. Documents of tokens, which take the most room, are only unpacked for a few blocks at a time."""
    common = len(layout.common)
    rare, one, two, w, c = ([] for _ in range(5))
    blocks, n = t["block"].to_numpy(), common
    rows = np.argsort(blocks).tolist()
    for words, *index, times in ([t[k][i].as_py() for k in ("words", "one", "two", "w", "c")] for i in rows):
        rare.append(unpack_sorted(words))
        for x, i in zip((one, two, w), unpack_ascending(*index, common + len(rare[-1])), strict=True):
            x.append((i + (i >= common) * (n - common)).astype(np.int32))
        c.append(unpack(times, np.uint32))
        n += len(rare[-1])
    size = np.array([len(x) for x in one])
    rare, one, two, w, c = (joined(x) for x in (rare, one, two, w, c))
    # of the words with short numbers, those that occur here
    here = np.zeros(n, bool)
    for x in (two, one, w):
        here[x] = True
    words, at = np.unique(np.concatenate([layout.common, rare])[here], return_inverse=True)
    place = np.zeros(n, np.int32)
    place[here] = at
    del rare, here, at
    one, two, w = place[one], place[two], place[w]
    told = np.zeros(len(words), bool)
    told[w] = True
    order, first = sorted_entries(len(words), len(words), one, two, w)
    total = np.add.reduceat(c[order], first, dtype=np.int64)
    old = total > 0
    place = np.empty(len(first), np.int32)
    place[np.concatenate([np.flatnonzero(old), np.flatnonzero(~old)])] = np.arange(len(first), dtype=np.int32)
    entry = np.empty(len(order), np.int32)
    entry[order] = np.repeat(place, np.diff(np.append(first, len(order))))
    e = order[first]
    del order, c, place
    seen, new = e[old], e[~old]
    asked = new[lookup(layout.frequent, words[one[new]])[1]]
    counts = Counts(words, np.flatnonzero(told), two[seen], one[seen], w[seen], total[old], one[asked], w[asked], two[new], one[new], w[new])
    n = len(first)
    del one, two, w, total, old, e, seen, new, asked, first
    made = counts.blobs()
    del counts

    def some() -> Iterator[tuple]:
        end, begin, held = np.cumsum(size), 0, []
        for k, i in enumerate(rows):
            times = unpack(t["times"][i].as_py(), np.uint32)
            held.append((i, times, unpack_docs(t["doc"][i].as_py(), int(times.sum(dtype=np.int64)))))
            if k == len(rows) - 1 or sum(len(x[2]) for x in held) >= MERGED_TOKENS:
                at = [x[0] for x in held]
                yield blocks[at], size[k + 1 - len(at) : k + 1], entry[begin : end[k]], *(np.concatenate([x[j] for x in held]) for j in (1, 2)), [t["head"][j].as_py() for j in at]
                begin = end[k]
                held.clear()

    return pa.table(_columns([(t["part"][0].as_py(), *made, *Asked.gathered(some(), n).blobs())], _COUNTS), _names(_COUNTS))


def count_words(docs: DataFrame, layout: Layout) -> DataFrame:
    """Counts and :class:`Asked` of the texts of ``docs`` (learn boolean, doc_id, text), one row for each part.

    Words of texts that are not learnt from are listed without occurrences, as they will be asked for.
    """
    sent = "part int, block long, words binary, one binary, two binary, w binary, c binary, times binary, doc binary, head binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (block, doc, held) in enumerate(_blocks(batches, layout, BLOCK_TOKENS)):
            number, n_docs = (task << 24) + n, sum(x.num_rows for x in held)
            learn = np.concatenate([x.column(0).to_numpy(zero_copy_only=False).astype(bool) for x in held])[doc]
            rows = []
            for p, words, i2, i1, iw, tokens, at in block.rows(layout, block.two, block.one, block.r):
                c = np.add.reduceat(learn[tokens].astype(np.uint32), at).astype(np.uint32)
                times = np.diff(np.append(at, len(tokens))).astype(np.uint32)
                rows.append((p, number, pack_sorted(words), *pack_ascending(i1, i2, iw), pack(c), pack(times), pack(doc[tokens].astype(least_type(n_docs))), b""))
            head = pa.record_batch([pa.concat_arrays([x.column(1) for x in held]), pa.array(np.bincount(doc, minlength=n_docs))], ["doc_id", "n_tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            k = (task + n) % len(rows)
            rows[k] = (*rows[k][:-1], sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(_columns(rows, sent), _names(sent))

    def merge(t: pa.Table) -> pa.Table:
        return merged_counts(t, layout)

    sent_rows = docs.mapInArrow(base.frugal(emit), sent)
    return base.bucketed(sent_rows.groupBy("part").applyInArrow(base.frugal_group(merge), _COUNTS), "part", layout.parts)


# --- seating ---


@dataclass(frozen=True)
class Prior:
    """Discount and concentration of each level (root, last words, pairs) and the base probability."""

    discount: tuple[float, float, float]
    strength: tuple[float, float, float]
    base_p: float


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Sampled numbers of tables of ``c`` customers of one word that sit down one after the other.

    With n seated at t tables the next one opens a table with probability a / (a + n - discount * t), where
    a = (strength + discount * (others + t)) * p. Between tables that only falls as n grows, so the next
    table is drawn by thinning: a geometric step under the present chance, accepted by the ratio of the chance
    there to it. That is the same as asking one customer at a time, in steps that grow with the tables.
    """
    t = np.minimum(c, 1).astype(np.int64)
    live = np.flatnonzero(c > 1)
    fixed, each = (strength + discount * others[live]) * p[live], discount * p[live]
    upto, n, made = c[live].astype(float), np.ones(len(live)), np.ones(len(live))
    while len(live):
        a = fixed + each * made
        rest = n - discount * made
        with np.errstate(divide="ignore"):
            at = n + np.floor(np.log(1 - rng.random(len(live))) / -np.log1p(a / rest))  # log(1 - a / (a + rest))
        end = np.minimum(2 * n, upto)
        met = at < end
        opened = met & (rng.random(len(live)) * (a + at - discount * made) < a + rest)
        made += opened
        n = np.where(met, at + 1, end)
        done = n >= upto
        t[live[done]] = made[done].astype(np.int64)
        left = ~done
        live, fixed, each, upto, n, made = (x[left] for x in (live, fixed, each, upto, n, made))
    return t


def numbered(new: np.ndarray) -> np.ndarray:
    """The number of each value of an ordered array, given where they change."""
    out = np.cumsum(new, dtype=np.int32)
    out -= 1
    return out


#: Entries that are scored at once.
STEP = 1 << 17


class Seating:
    """The restaurants of one part: all pairs of words, and of the last words those that are not frequent."""

    def __init__(self, counts: Counts, layout: Layout) -> None:
        # one number more than there are words stands for a context that the part does not know
        n = self.n = len(counts.words) + 1
        every = np.concatenate([counts.one.astype(np.int64) * n + counts.w, counts.asked_one.astype(np.int64) * n + counts.asked_w])
        self.pair, at = np.unique(every, return_inverse=True)
        self.p = at[: len(counts.c)].astype(np.int32)
        del every, at
        context = counts.one.astype(np.int64) * n + counts.two  # in order
        new = changes(context)
        self.context, self.u = context[new], numbered(new)
        del context
        none = np.zeros(0, np.int32)
        self.counts = replace(counts, two=none, one=none, asked_one=none, asked_w=none)
        last = self.pair // n
        new = changes(last)
        self.last, self.v = last[new], numbered(new)
        self.pair_w = (self.pair - last * n).astype(np.int32)
        self.frequent = lookup(layout.frequent, counts.words[self.last])[1][self.v]
        #: Frequent words' pairs in the order in which they are reported.
        self.shared = np.flatnonzero(self.frequent)
        self.shared = self.shared[np.lexsort((self.pair[self.shared], self.pair_w[self.shared]))]
        # customers that are alone have their one table whatever happens
        self.many = np.flatnonzero(counts.c > 1).astype(np.int32)
        self.least2, self.least3 = np.bincount(self.p, minlength=len(self.pair)).astype(np.int32), np.bincount(self.u, minlength=len(self.context)).astype(np.int32)
        self.t3 = np.ones(len(counts.c), np.int32)
        self.t2 = (self.c2 > 0).astype(np.int64)
        self.full3 = np.bincount(self.u, weights=counts.c, minlength=len(self.context))

    @property
    def c2(self) -> np.ndarray:
        return self.least2 + np.bincount(self.p[self.many], weights=self.t3[self.many] - 1, minlength=len(self.pair)).astype(np.int64)

    @property
    def full2(self) -> np.ndarray:
        return np.bincount(self.v, weights=self.c2, minlength=len(self.last))

    @property
    def tables3(self) -> np.ndarray:
        return self.least3 + np.bincount(self.u[self.many], weights=self.t3[self.many] - 1, minlength=len(self.context))

    @property
    def tables2(self) -> np.ndarray:
        return np.bincount(self.v, weights=self.t2, minlength=len(self.last))

    def to_root(self) -> np.ndarray:
        """Customers that each word sends to the root from here."""
        own = ~self.frequent
        return np.bincount(self.pair_w[own], weights=self.t2[own], minlength=self.n).astype(np.int64)

    def sweep(self, root_p: np.ndarray, shared_p: np.ndarray, prior: Prior, rng: np.random.Generator) -> None:
        """Seat everything anew, given the words' probabilities in the root and in frequent words' restaurants."""
        (_, d2, d3), (_, s2, s3) = prior.discount, prior.strength
        c2, total2, tables2 = self.c2, self.full2, self.tables2
        # the parent's probability of a word without the tables that are about to leave
        many = self.many
        at, gone = self.p[many], self.t3[many]
        c = c2[at] - gone
        t = np.minimum(self.t2[at], c)
        v, w = self.v[at], self.pair_w[at]
        free = np.where(c > 0, c - d2 * t, 0.0)
        p = (free + (s2 + d2 * tables2[v]) * root_p[w]) / (s2 + np.maximum(total2[v] - gone, 0))
        told = np.zeros(len(self.pair))
        told[self.shared] = shared_p
        p = np.where(self.frequent[at], told[at], p)
        self.t3[many] = seat(self.counts.c[many], self.tables3[self.u[many]] - gone, p, d3, s3, rng)
        c2 = self.c2
        several = np.flatnonzero(~self.frequent & (c2 > 1))
        before = self.t2[several]
        self.t2 = np.minimum(c2, 1)
        self.t2[several] = seat(c2[several], tables2[self.v[several]] - before, root_p[self.pair_w[several]], d2, s2, rng)

    def statistics(self) -> np.ndarray:
        own = np.unique(self.v[~self.frequent])
        c2 = self.c2[~self.frequent]
        once = [(x == k).sum() for x in (c2, self.counts.c) for k in (1, 2)]
        return np.concatenate([histogram(self.full2[own]), histogram(self.tables2[own]), histogram(self.full3), histogram(self.tables3), once]).astype(float)

    def predictor(self, root_p: np.ndarray, shared_p: np.ndarray, prior: Prior):
        """A function of (two, one, word), by index into the part's words, that gives their predictive probabilities."""
        (_, d2, d3), (_, s2, s3) = prior.discount, prior.strength
        n, c2, full2, tables2, tables3 = self.n, self.c2, self.full2, self.tables2, self.tables3
        kept2, entries = np.where(c2 > 0, c2 - d2 * self.t2, 0.0), self.u.astype(np.int64) * n + self.counts.w
        told = np.zeros(len(self.pair))
        told[self.shared] = shared_p

        def predict(two: np.ndarray, one: np.ndarray, w: np.ndarray) -> np.ndarray:
            p = root_p[w]
            v, known = lookup(self.last, one)
            if len(self.last):
                pair, seen = lookup(self.pair, one.astype(np.int64) * n + w)
                local = (np.where(seen, kept2[pair], 0.0) + (s2 + d2 * tables2[v]) * p) / (s2 + full2[v])
                p = np.where(known, np.where(seen & self.frequent[pair], told[pair], local), p)
            u, known = lookup(self.context, one.astype(np.int64) * n + two)
            if len(self.context):
                entry, seen = lookup(entries, u * n + w)
                p = np.where(known, (np.where(seen, self.counts.c[entry] - d3 * self.t3[entry], 0.0) + (s3 + d3 * tables3[u]) * p) / (s3 + self.full3[u]), p)
            return p

        return predict

    def own(self, root_p: np.ndarray, shared_p: np.ndarray, prior: Prior) -> np.ndarray:
        """The predictive probabilities of the entries that occur."""
        (_, d2, d3), (_, s2, s3) = prior.discount, prior.strength
        c2 = self.c2
        kept = np.where(c2 > 0, c2 - d2 * self.t2, 0.0)
        p = (kept + (s2 + d2 * self.tables2)[self.v] * root_p[self.pair_w]) / (s2 + self.full2)[self.v]
        p[self.shared] = shared_p
        back, full = s3 + d3 * self.tables3, s3 + self.full3
        out = np.empty(len(self.u))
        for i in range(0, len(out), STEP):
            cut = slice(i, i + STEP)
            u = self.u[cut]
            out[cut] = (self.counts.c[cut] - d3 * self.t3[cut] + back[u] * p[self.p[cut]]) / full[u]
        return out


#: Sizes below 64 have a bin each, larger ones eight bins to a doubling.
BINS = 64 + 8 * 57


def histogram(x: np.ndarray) -> np.ndarray:
    """Numbers of positive sizes by bin, then their sums."""
    x = np.asarray(x, float)
    x = x[x > 0]
    at = np.where(x < 64, x, 64 + np.floor(8 * np.log2(np.maximum(x, 64) / 64))).astype(np.int64)
    return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=x, minlength=BINS)])


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def concentration(customers: np.ndarray, tables: np.ndarray, discount: float, rounds: int = 60) -> float:
    """The concentration of restaurants with these histograms of customers and tables.

    Expectation steps for the usual auxiliary variables (a beta one for each restaurant, a coin for each
    further table) under a Gamma(1, 1) prior.
    """

    def read(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, total = h[:BINS], h[BINS:]
        return n[n > 0], total[n > 0] / n[n > 0]

    (nc, c), (nt, t) = read(customers), read(tables)
    s = 1.0
    for _ in range(rounds):
        coins = float((nt * s / discount * (digamma(s / discount + t) - digamma(np.full(len(t), s / discount + 1)))).sum())
        logs = float((nc * (digamma(np.full(len(c), s + 1)) - digamma(s + np.maximum(c, 1)))).sum())
        s = min(max((1 + max(coins, 0.0)) / (1 - logs), 1e-3), 1e6)
    return s


# --- what parts and groups of words tell each other ---

_REPORT = "grp int, part int, words binary, seen binary, roots binary, pair_word binary, pair_last binary, customers binary, stats binary"
_SHARED = "grp int, words binary, seen binary, cold binary, pair_w binary, pair_r binary, customers binary, stats binary, parts binary, sizes binary, to_word binary, to_pair binary"
_ANSWER = "part int, kind int, grp int, a binary, b binary, c binary"


def reports(part: int, seating: Seating, layout: Layout, samples: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray) -> Iterator[tuple]:
    """Rows for each group of words: per sample the customers that go to the root and to frequent words' restaurants."""
    counts, shared, told = seating.counts, seating.shared, seating.counts.told
    words = counts.words[told]
    group = scaled(words, layout.parts)
    seen = np.bincount(counts.w, weights=counts.c, minlength=seating.n).astype(np.int64)[told]
    samples = [(r[told], x) for r, x in samples]
    cut = np.searchsorted(group, np.arange(layout.parts + 1))
    pair_w = np.searchsorted(told, seating.pair_w[shared])
    cut_pair = np.searchsorted(group[pair_w], np.arange(layout.parts + 1)) if len(shared) else np.zeros(layout.parts + 1, np.int64)
    last = lookup(layout.frequent, counts.words[seating.last[seating.v[shared]]])[0]
    for g in np.union1d(np.flatnonzero(np.diff(cut)), [part]).tolist():
        i, j, k, m = cut[g], cut[g + 1], cut_pair[g], cut_pair[g + 1]
        roots = np.concatenate([r[i:j] for r, _ in samples]).astype(np.uint32)
        customers = np.concatenate([x[k:m] for _, x in samples]).astype(np.uint32)
        own = pack(stats) if g == part else None
        yield g, part, pack_sorted(words[i:j]), pack(seen[i:j].astype(np.uint32)), pack(roots), pack((pair_w[k:m] - i).astype(np.uint32)), pack(last[k:m].astype(np.uint32)), pack(customers), own


def merged_reports(t: pa.Table) -> pa.Table:
    """All parts' reports on one group of words, and who asked for what."""
    rows = t.sort_by("part").to_pylist()
    words = [unpack_sorted(r["words"]) for r in rows]
    size = np.array([len(x) for x in words])
    every, to_word = np.unique(np.concatenate(words), return_inverse=True)
    start = np.cumsum(size) - size
    add = lambda at, v, n: np.bincount(at, weights=v, minlength=n).astype(np.int64)
    seen = add(to_word, np.concatenate([unpack(r["seen"], np.uint32) for r in rows]), len(every))
    roots = [unpack(r["roots"], np.uint32) for r in rows]
    kept = max((len(x) // n for x, n in zip(roots, size, strict=True) if n), default=1)
    cold = np.array([add(to_word, np.concatenate([x[s * n : (s + 1) * n] for x, n in zip(roots, size, strict=True)]), len(every)) for s in range(kept)])
    at = np.concatenate([to_word[unpack(r["pair_word"], np.uint32).astype(np.int64) + b] for r, b in zip(rows, start, strict=True)])
    last = [unpack(r["pair_last"], np.uint32).astype(np.int64) for r in rows]
    pairs = np.array([len(x) for x in last])
    key, to_pair = np.unique((np.concatenate(last) << 32) | at, return_inverse=True)
    got = [unpack(r["customers"], np.uint32) for r in rows]
    customers = np.array([add(to_pair, np.concatenate([x[s * n : (s + 1) * n] for x, n in zip(got, pairs, strict=True)]), len(key)) for s in range(kept)])
    stats = sum(unpack(r["stats"], np.float64) for r in rows if r["stats"] is not None)
    row = (
        t["grp"][0].as_py(), pack_sorted(every), pack(seen), pack(cold), pack((key & 0xFFFFFFFF).astype(np.uint32)), pack((key >> 32).astype(np.uint32)), pack(customers),
        pack(stats) if isinstance(stats, np.ndarray) else None,
        pack(np.array([r["part"] for r in rows], np.int32)), pack(np.concatenate([size, pairs])), pack(to_word.astype(np.uint32)), pack(to_pair.astype(np.uint32)),
    )
    return pa.table(_columns([row], _SHARED), _names(_SHARED))


class Shared:
    """One sample of the root and of frequent words' restaurants, for one group of words."""

    def __init__(self, row: dict, sample: int) -> None:
        self.words, self.seen = unpack_sorted(row["words"]), unpack(row["seen"], np.int64)
        self.w, self.r = unpack(row["pair_w"], np.uint32).astype(np.int64), unpack(row["pair_r"], np.uint32).astype(np.int64)
        self.cold = unpack(row["cold"], np.int64)[sample * len(self.words) :][: len(self.words)]
        self.c = unpack(row["customers"], np.int64)[sample * len(self.w) :][: len(self.w)]
        self.t = np.minimum(self.c, 1)
        self.t_root = np.minimum(self.c_root, 1)

    @property
    def c_root(self) -> np.ndarray:
        return self.cold + np.bincount(self.w, weights=self.t, minlength=len(self.words)).astype(np.int64)

    def totals(self, frequent: int) -> np.ndarray:
        """Customers, then tables, of the root and of each frequent word's restaurant."""
        add = lambda v: np.bincount(self.r, weights=v, minlength=frequent)
        return np.concatenate([[self.c_root.sum()], add(self.c), [self.t_root.sum()], add(self.t)]).astype(float)

    def root_p(self, prior: Prior, total: float, tables: float) -> np.ndarray:
        d, s = prior.discount[0], prior.strength[0]
        return (self.c_root - d * self.t_root + (s + d * tables) * prior.base_p) / (s + total)

    def pair_p(self, prior: Prior, totals: np.ndarray) -> np.ndarray:
        n = len(totals) // 2
        d, s = prior.discount[1], prior.strength[1]
        root = self.root_p(prior, totals[0], totals[n])[self.w]
        return (self.c - d * self.t + (s + d * totals[n + 1 :][self.r]) * root) / (s + totals[1:n][self.r])

    def sweep(self, totals: np.ndarray, prior: Prior, rng: np.random.Generator) -> None:
        n = len(totals) // 2
        (d1, d2, _), (s1, s2, _) = prior.discount, prior.strength
        root = self.root_p(prior, totals[0], totals[n])
        self.t = seat(self.c, totals[n + 1 :][self.r] - self.t, root[self.w], d2, s2, rng)
        c = self.c_root
        self.t_root = seat(c, np.full(len(c), totals[n]) - np.minimum(self.t_root, c), np.full(len(c), prior.base_p), d1, s1, rng)


def seated(row: dict, sample: int, totals: list[np.ndarray], prior: Prior | None, seed: int) -> Shared:
    """The state after a sweep under each of ``totals``; the same on every call."""
    state = Shared(row, sample)
    for i, x in enumerate(totals):
        state.sweep(x, prior, np.random.default_rng([seed, row["grp"], sample, i]))
    return state


@dataclass(frozen=True)
class Round:
    """What a round of reports led to: the groups' rows, each sample's totals before and after its sweep (if there was one), sums over all parts."""

    shared: DataFrame
    totals: list[list[np.ndarray]]
    stats: np.ndarray
    words: int
    tokens: int
    once: tuple[np.ndarray, np.ndarray]  # root words and frequent words' pairs with one and two customers

    def prior(self, frequent: int) -> Prior:
        """Discounts from words seen once and twice, concentrations from the seating."""
        h = 2 * BINS
        n2, n3 = self.stats[4 * h : 4 * h + 2], self.stats[4 * h + 2 :]
        discount = tuple(float(np.clip(x[0] / max(1.0, x[0] + 2 * x[1]), 0.05, 0.98)) for x in (self.once[0], n2 + self.once[1], n3))
        now = self.totals[0][-1]
        c, t = now[: 1 + frequent], now[1 + frequent :]
        of2 = [self.stats[:h] + histogram(c[1:]), self.stats[h : 2 * h] + histogram(t[1:])]
        root = [histogram(c[:1]), histogram(t[:1])]
        strength = (concentration(*root, discount[0]), concentration(*of2, discount[1]), concentration(self.stats[2 * h : 3 * h], self.stats[3 * h : 4 * h], discount[2]))
        return Prior(discount, strength, 1.0 / (self.words + 1))


def _sums(shared: DataFrame, samples: int, totals: list[list[np.ndarray]], prior: Prior | None, frequent: int, seed: int, whole: bool) -> dict[int, np.ndarray]:
    def make(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}

        def add(k: int, v: np.ndarray) -> None:
            out[k] = out[k] + v if k in out else np.array(v, float)

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                for s in range(samples):
                    state = seated(row, s, [x[s] for x in totals], prior, seed)
                    add(s, state.totals(frequent))
                if whole:
                    add(samples, np.array([(state.seen > 0).sum(), state.seen.sum(), *((x == k).sum() for x in (state.c_root, state.c) for k in (1, 2))]))
                    if row["stats"] is not None:
                        add(samples + 1, unpack(row["stats"], np.float64))
        return out

    return base.summed_vectors(shared, make)


def settle(sent: DataFrame, layout: Layout, samples: int, prior: Prior | None, seed: int, sweep: bool = True) -> tuple[Round, Prior]:
    """Seat the shared restaurants from the parts' reports; estimates a prior where none is given."""
    frequent = len(layout.frequent)
    shared = base.stored(sent.groupBy("grp").applyInArrow(base.frugal_group(merged_reports), _SHARED))
    got = _sums(shared, samples, [], None, frequent, seed, True)
    empty = np.zeros(2 + 2 * frequent)
    first = [got.get(s, empty) for s in range(samples)]
    n = got.get(samples, np.zeros(6))
    stats = got.get(samples + 1, np.zeros(8 * BINS + 4))
    state = Round(shared, [[x] for x in first], stats, int(n[0]), int(n[1]), (n[2:4], n[4:6]))
    prior = prior or state.prior(frequent)
    if not sweep:
        return state, prior
    after = _sums(shared, samples, [first], prior, frequent, seed, False)
    return replace(state, totals=[[x, after.get(s, empty)] for s, x in enumerate(first)]), prior


def answers(state: Round, prior: Prior, kind: int, seed: int) -> DataFrame:
    """Rows for the parts: each sample's probabilities of the words and pairs they reported, and the words' occurrences."""
    totals = state.totals

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                n = len(totals[0][-1]) // 2
                root, pair = [], []
                for s, (*before, after) in enumerate(totals):
                    x = seated(row, s, before, prior, seed)
                    root.append(x.root_p(prior, after[0], after[n]).astype(np.float32))
                    pair.append(x.pair_p(prior, after).astype(np.float32))
                parts = unpack(row["parts"], np.int32)
                size, pairs = unpack(row["sizes"], np.int64).reshape(2, -1)
                at, to = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(pairs)])
                to_word, to_pair = unpack(row["to_word"], np.uint32).astype(np.int64), unpack(row["to_pair"], np.uint32).astype(np.int64)
                rows = []
                for k, part in enumerate(parts.tolist()):
                    w, p = to_word[at[k] : at[k + 1]], to_pair[to[k] : to[k + 1]]
                    rows.append((part, kind, row["grp"], pack(np.concatenate([r[w] for r in root])), pack(np.concatenate([r[p] for r in pair])), pack(x.seen[w])))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays(_columns(rows, _ANSWER), _names(_ANSWER))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(_columns(rows, _ANSWER), _names(_ANSWER))

    return state.shared.mapInArrow(base.frugal(tell), _ANSWER)


def read_answers(rows: list[dict], kind: int, samples: int, told: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per sample the probabilities of the part's ``n`` words and of its shared pairs; the words' occurrences in training. Only ``told`` words have them."""
    rows = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["grp"])
    root, pair, seen = ([unpack(r[c], k) for r in rows] for c, k in (("a", np.float32), ("b", np.float32), ("c", np.int64)))
    joined = lambda x, s: np.concatenate([y.reshape(samples, -1)[s] for y in x]).astype(float)

    def by_word(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, x.dtype)
        out[told] = x
        return out

    return [by_word(joined(root, s)) for s in range(samples)], [joined(pair, s) for s in range(samples)], by_word(np.concatenate(seen))


def samples_of(seating: Seating, part: int, root: np.ndarray, pair: np.ndarray, prior: Prior, seed: int, kept: int) -> Iterator[Seating]:
    """The seating after each sweep that is kept; the same on every call."""
    for i in range(BURN_IN + kept if kept > 1 else 0):
        seating.sweep(root, pair, prior, np.random.default_rng([seed, part, i]))
        if i >= BURN_IN:
            yield seating
    if kept == 1:
        yield seating


# --- the whole model ---


@dataclass(frozen=True)
class Model:
    """All that scoring needs: the counts, the two rounds of answers and their priors."""

    layout: Layout
    counts: DataFrame
    first: Round
    last: Round
    priors: tuple[Prior, Prior]
    kept: int
    seed: int

    @property
    def train_tokens(self) -> int:
        return self.first.tokens

    @property
    def words(self) -> int:
        return self.first.words


def fit(docs: DataFrame, learn: Column | None = None, *, sweeps: bool = True, seed: int = 17, part_bytes: int = PART_BYTES, share: float = 0.25) -> Model:
    """Sample the seating of the texts of ``docs`` that ``learn`` admits (all by default; null admits none).

    ``docs`` also holds the texts to be scored, so that parts know which words they will be asked for.
    Without ``sweeps`` every word has one table in each restaurant, as interpolated Kneser-Ney would have it.
    """
    flag = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    texts = docs.select(flag.alias("learn"), "doc_id", "text")
    layout = plan_layout(texts, part_bytes=part_bytes, share=share)
    stored = count_words(texts, layout)
    base.let_go(docs.sparkSession)
    # short numbers were for sending
    layout = replace(layout, common=layout.common[:0])
    counts = stored.select(*_names(_SEATED))
    kept = KEPT if sweeps else 1

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                s = Seating(Counts.read(row), layout)
                rows = list(reports(row["part"], s, layout, [(s.to_root(), s.c2[s.shared])], s.statistics()))
                yield pa.RecordBatch.from_arrays(_columns(rows, _REPORT), _names(_REPORT))

    first, prior = settle(counts.mapInArrow(base.frugal(begin), _REPORT), layout, 1, None, seed, sweeps)
    if not sweeps:
        return Model(layout, stored, first, first, (prior, prior), 1, seed)

    def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in right.to_pylist():
            s = Seating(Counts.read(row), layout)
            (root,), (pair,), _ = read_answers(left.to_pylist(), 0, 1, s.counts.told, s.n)
            got = []
            for x in samples_of(s, row["part"], root, pair, prior, seed, kept):
                got.append((x.to_root(), x.c2[x.shared]))
            rows += reports(row["part"], s, layout, got, s.statistics())
        return pa.table(_columns(rows, _REPORT), _names(_REPORT))

    told = answers(first, prior, 0, seed)
    sent = told.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(base.frugal_pair(go_on), _REPORT)
    last, _ = settle(sent, layout, kept, prior, seed + 1)
    # discounts stay as estimated from the counts; the concentrations follow the seating
    newer = Prior(prior.discount, last.prior(len(layout.frequent)).strength, prior.base_p)
    base.let_go(docs.sparkSession)
    return Model(layout, stored, first, last, (prior, newer), kept, seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row; ``docs`` are those that the model was fitted with.

    Their tokens were stored then, so the texts are not read again. A null or empty text is its end alone. Repeated
    rows stay repeated, a null doc_id stays null, other columns are not read. Rows of an empty table, or without a text to learn from, score 0.
    """
    layout, kept, seed = model.layout, model.kept, model.seed
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_train, n_words = model.train_tokens, model.words
    (prior, newer), still = model.priors, model.kept == 1

    rated_as = "block long, doc binary, base binary, score binary, known binary, ids binary"

    def entry_scores(left: pa.Table, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability of each entry, its word, occurrences of each word in training)."""
        counts = Counts.read(row)
        seating = Seating(counts, layout)
        counts = seating.counts
        rows = left.to_pylist()
        root0, pair0, seen = read_answers(rows, 0, 1, counts.told, seating.n)
        if still:
            root1, pair1 = root0, pair0
        else:
            root1, pair1, seen = read_answers(rows, 1, kept, counts.told, seating.n)
        del rows
        own, n = len(counts.c), len(counts.c) + len(counts.new_w)
        p = np.zeros(n)
        for s, x in enumerate(samples_of(seating, row["part"], root0[0], pair0[0], prior, seed, kept)):
            p[:own] += x.own(root1[s], pair1[s], newer)
            predict = x.predictor(root1[s], pair1[s], newer)
            for i in range(0, n - own, STEP):
                cut = slice(i, i + STEP)
                p[own:][cut] += predict(counts.new_two[cut], counts.new_one[cut], counts.new_w[cut])
            del predict
        p /= kept
        np.log10(np.minimum(p, 1.0, out=p), out=p)
        return p, np.concatenate([counts.w, counts.new_w]), seen

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in right.to_pylist():
            high, w, seen = entry_scores(left, row)
            low, known = np.log10((seen + 1) / (n_train + n_words + 1)), (seen > 0).astype(float)
            asked = Asked.read(row)
            for block, entry, times, doc in asked.each(len(w)):
                d, word = np.flatnonzero(np.bincount(doc)), w[entry]
                add = lambda x: np.bincount(doc, weights=np.repeat(x, times))[d]  # noqa: B023, E731
                out.append((block, pack(d.astype(np.uint32)), pack(add(low[word])), pack(add(high[entry]).astype(np.float32)), pack(add(known[word]).astype(np.uint32)), None))
            out += [(block, None, None, None, None, head) for block, head in zip(asked.blocks.tolist(), asked.heads, strict=True) if head]
        return pa.table(_columns(out, rated_as), _names(rated_as))

    def gather(t: pa.Table) -> pa.Table:
        head = pa.ipc.open_stream(next(x for x in t["ids"].to_pylist() if x is not None)).read_all()
        n = head.num_rows
        known, low, high = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        body = t.filter(pa.compute.is_valid(t["doc"]))
        parts = sorted(body.to_pylist(), key=lambda r: r["doc"])  # the same sums whatever the order of arrival
        for r in parts:
            at = unpack(r["doc"], np.uint32).astype(np.int64)
            known[at] += unpack(r["known"], np.uint32)
            low[at] += unpack(r["base"], np.float64)
            high[at] += unpack(r["score"], np.float32)
        return pa.table([head["doc_id"], head["n_tokens"], pa.array(known), pa.array(low), pa.array(high)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    sent = answers(model.first, prior, 0, seed)
    if not still:
        sent = sent.unionByName(answers(model.last, prior, 1, seed + 1))
    rated = sent.groupBy("part").cogroup(model.counts.groupBy("part")).applyInArrow(base.frugal_pair(rate), rated_as)
    return rated.groupBy("block").applyInArrow(base.frugal_group(gather), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity(scores: DataFrame) -> Column:
    """10 to the negative mean log10 probability of a token, as an aggregate over rows of :func:`score`."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))
