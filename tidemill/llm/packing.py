"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents of one length are interchangeable, so the packing is planned on the histogram of piece
lengths, which has at most ``capacity`` entries however many documents there are. The plan is a list
of patterns (the lengths in one sequence) with how often each is used; pieces then find their place
by their rank among the pieces of their length. Only (id, length, checksum) rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, tokens
from . import text as T

Pattern = tuple[list[int], int]


def best_two_fit(histogram: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that use ``histogram[n]`` pieces of each length n <= ``capacity``.

    A bin starts with the longest piece left and takes the longest that fits until none does. While
    two unpacked pieces fit the gap that its smallest piece (the first one aside) would leave, and
    more tightly than that one, they replace it. A pattern is used as often as its pieces last.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    longest = np.zeros(capacity + 1, np.int64)
    patterns: list[Pattern] = []
    index = np.arange(capacity + 1)
    while left.any():
        free = left.copy()
        np.maximum.accumulate(np.where(free > 0, index, 0), out=longest)

        def take(n: int) -> None:
            free[n] -= 1
            if not free[n]:
                np.maximum.accumulate(np.where(free > 0, index, 0), out=longest)

        pack = [int(longest[capacity])]
        take(pack[0])
        gap = capacity - pack[0]
        while gap and (n := int(longest[gap])):
            pack.append(n)
            take(n)
            gap -= n
        while gap and len(pack) > 1:
            smallest = min(pack[1:])
            room = gap + smallest
            a = index[1:room]
            a = a[free[a] > 0]
            b = longest[np.minimum(a, room - a)]
            twin = (b == a) & (free[a] < 2)
            b = np.where(twin, longest[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if not len(a) or total.max() <= smallest:
                break
            i = int(total.argmax())
            pack.remove(smallest)
            free[smallest] += 1
            pack += [int(a[i]), int(b[i])]
            free[a[i]] -= 1
            free[b[i]] -= 1
            np.maximum.accumulate(np.where(free > 0, index, 0), out=longest)
            gap = room - int(total[i])
        used = np.bincount(pack, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        patterns.append((sorted(pack, reverse=True), times))
    return patterns


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each stretch of ranks of a length: its length, first rank, first sequence and offset there, by length and rank."""
    rows, seen, sequence = [], {}, 0
    for pack, times in patterns:
        offset = 0
        for n in pack:
            rows.append((n, seen.get(n, 0), sequence, offset))
            seen[n] = seen.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {k: cols[:, i] for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def load_tokenizer(spec: str):
    """A tokenizer from its JSON, encoding in one thread of the task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def token_pieces(docs: DataFrame, spec: str, *, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: each document's ids and end id, cut only if longer than ``capacity``.

    The first piece takes what the others leave, so that they fill whole sequences. ``salt`` tells repeated rows apart.
    """

    def ready():
        tok = load_tokenizer(spec)
        return tok, tokens.UnitCache(lambda units: [e.ids for e in tok.encode_batch_fast(units, add_special_tokens=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cache = tokens.kept(("byte-level", spec), ready)
        made = 0
        for b in batches:
            for s in T.slices(b.column(1)):
                whole = tokens.has_wide_space(s)
                doc, start, size = tokens.byte_level_units(s)
                plain = ~whole[doc]
                flat, n = cache.lookup(s, start[plain], size[plain])
                count = np.bincount(doc[plain], weights=n, minlength=s.n).astype(np.int64)
                stop = np.cumsum(count)
                rows: list[tuple] = []
                for i in range(s.n):
                    ids = flat[stop[i] - count[i] : stop[i]]
                    if whole[i]:
                        ids = np.array(tok.encode(s.buf[s.begin[i] : s.end[i]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
                    raw = memoryview(np.append(ids, end_id).astype("<u4").tobytes())
                    n_ids = len(ids) + 1
                    at, k = 0, 0
                    while at < n_ids:
                        size_k = (n_ids - at) % capacity or capacity
                        rows.append((s.first + i, k, at, size_k, zlib.crc32(raw[4 * at : 4 * (at + size_k)])))
                        at, k = at + size_k, k + 1
                cols = list(zip(*rows, strict=True))
                salt = np.arange(made, made + len(rows)) & 0x7FFFFFFF
                made += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(salt, pa.int32())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(base.frugal(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt int")


#: Pieces of one length that are ranked together, about.
RANKED = 5_000


def pack(docs: DataFrame, spec: str, *, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Each document's pieces with their sequence_id and offset.

    A null or empty text has only the end id. Repeated rows are packed as often as they stand; a null
    doc_id stays null; other columns are not read. ``spec``: the tokenizer's JSON. An empty table gives no rows.
    """
    pieces = base.stored(token_pieces(docs, spec, end_id=end_id, capacity=capacity))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r.length] = r["count"]
    plan = slots(best_two_fit(histogram, capacity))
    if not len(plan["length"]):
        return pieces.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "0L AS sequence_id", "0L AS offset")

    # ranks by length: within hashed buckets of bounded size, as many as the length needs, after the buckets before
    buckets = F.array(*(F.lit(int(n // RANKED + 1)) for n in histogram))
    held = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.get(buckets, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = held.withColumn("rn", F.row_number().over(within)).join(first, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rn") - 1).alias("rank"))

    key = (plan["length"] << 44) + plan["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(5).to_numpy()
            at = np.searchsorted(key, (b.column(3).to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(plan["sequence"][at] + rank - plan["rank"][at]), pa.array(plan["offset"][at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(base.frugal(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
