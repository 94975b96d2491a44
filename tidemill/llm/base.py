"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, remove_at_exit, shared_dir, stored


__all__ = ["at_most", "bounded_broadcast", "bucketed", "fold", "free_name", "frugal", "frugal_group", "frugal_pair", "joined_hot", "joined_members", "known_rows", "let_go", "shared_dir", "shuffle_partitions", "stored", "summed_vectors", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_LIBC: list = []


def _give_back() -> None:
    """Return what this Python worker has freed to the system.

    Workers outlive their tasks, and an allocator that keeps freed blocks lets them grow to the
    largest task they ever ran. Large arrays so go back when freed, the rest when a task ends.
    """
    if not _LIBC:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
            _LIBC.append(libc.malloc_trim)
        except (OSError, AttributeError):  # another C library
            _LIBC.append(lambda _: 0)
    _LIBC[0](0)


def frugal(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches for ``mapInArrow`` whose worker gives memory back at its ends."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return run


def frugal_group(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group."""

    def run(t: pa.Table) -> pa.Table:
        _give_back()
        return fn(t)

    return run


def frugal_pair(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two co-grouped groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _give_back()
        return fn(left, right)

    return run


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` stored by buckets of ``key``, so that later grouping by it reads each bucket where it lies, without a shuffle."""
    spark = df.sparkSession
    name = f"tidemill_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name, format="parquet")
    remove_at_exit(spark, path, name)
    return spark.table(name)


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; else as it is, for a shuffled join."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer used, which it does when the driver's objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


#: Copies of the rows of a join's right side that frequent keys of the left side are dealt to.
SALTS = 16


#: Upper bounds on the rows of frames, as far as they are known without counting.
_ROWS: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def at_most(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, noted to have at most ``rows`` rows."""
    if rows is not None:
        _ROWS[df] = rows
    return df


def known_rows(df: DataFrame) -> int | None:
    return _ROWS.get(df)


def joined_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str, max_rows: int) -> DataFrame:
    """``left`` joined to ``right``, which has one row for a key, where a key may have a third of the rows of ``left``.

    A right side of at most ``max_rows`` rows is broadcast; a larger one is copied ``SALTS`` times, and each row of
    ``left`` meets one of the copies, so no task gets more than a share of a key.
    """
    known = known_rows(right)
    if (known if known is not None and known <= max_rows else right.limit(max_rows + 1).count()) <= max_rows:
        return left.join(F.broadcast(right), keys, how)
    salt = free_name(left.columns + right.columns, "salt")
    dealt = left.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    copies = right.withColumn(salt, F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


#: Bits of the table of hashed keys that members are looked for in before they are joined, 64 to a row; rows of that table are all that is broadcast.
MEMBER_BITS = 1 << 22


def joined_members(left: DataFrame, right: DataFrame, key: str, max_rows: int) -> DataFrame:
    """``left`` joined to ``right``, which has one row for a key, where most rows of ``left`` are wide and have no partner.

    A right side of at most ``max_rows`` rows is broadcast. For a larger one only bits of its hashed keys are, ``MEMBER_BITS`` of them
    whatever its size: rows of ``left`` without their bit are left out before the others are dealt by key.
    """
    known = known_rows(right)
    if (known if known is not None and known <= max_rows else right.limit(max_rows + 1).count()) <= max_rows:
        return left.join(F.broadcast(right), key, "inner")
    row, bits = free_name(left.columns + right.columns, "row"), free_name(left.columns + right.columns, "bits")
    at = F.pmod(F.xxhash64(key), F.lit(MEMBER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    table = right.select(F.floor(at / 64).alias(row), bit.alias(bits)).groupBy(row).agg(F.bit_or(bits).alias(bits))
    likely = left.withColumn(row, F.floor(at / 64)).join(F.broadcast(table), row, "inner").where(F.col(bits).bitwiseAND(bit) != 0)
    return likely.drop(row, bits).join(right.hint("shuffle_merge"), key, "inner")


def free_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


SLICES = 16


def vector_rows(vectors: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row (vector number, slice, float64 values as bytes) for each slice of each vector."""
    key, part, v = [], [], []
    for k, x in vectors.items():
        for i, y in enumerate(np.array_split(x.astype(np.float64), SLICES)):
            key.append(k)
            part.append(i)
            v.append(y.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(part, pa.int32()), pa.array(v, pa.binary())], ["k", "part", "v"])


def summed_vectors(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Element-wise sums over all partitions of the vectors that ``fn`` makes of each; their lengths are fixed.

    Partial sums are merged by a stream for each slice, which holds one accumulator whatever the
    number of partitions; only the finished vectors reach the driver.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from vector_rows(fn(batches))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, p, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(v, np.float64)
                acc[k, p] = acc[k, p] + x if (k, p) in acc else x
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in acc], pa.int32()), pa.array([p for _, p in acc], pa.int32()), pa.array([x.tobytes() for x in acc.values()], pa.binary())],
            ["k", "part", "v"],
        )

    schema = "k int, part int, v binary"
    rows = df.mapInArrow(frugal(make), schema).repartition(SLICES, "part").mapInArrow(frugal(merge), schema).collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r.k, {})[r.part] = np.frombuffer(r.v, np.float64)
    return {k: np.concatenate([v[i] for i in sorted(v)]) for k, v in out.items()}
