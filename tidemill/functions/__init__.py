"""Column functions shared by the operators. Missing is always NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-10


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all float columns as NULL."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)})


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_double(c: Column) -> Column:
    """Number or NULL, never an error."""
    return finite(c.try_cast("double"))


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip_low(c: Column, low: float) -> Column:
    """max(c, low) that keeps NULL."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def any_null(*cols: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in cols))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sine, cosine) of a position in a period."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def parse_timestamp(c: Column, *formats: str) -> Column:
    """The first of the formats that fits the trimmed text, as a timestamp without zone; else NULL."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats)).cast("timestamp_ntz")


def resolve(df: DataFrame, *names: str) -> dict[str, str]:
    """Actual column of each wanted name, whatever its case; KeyError for a missing one."""
    have = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return {n: have[n.lower()] for n in names}
