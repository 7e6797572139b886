"""Column helpers that pin down the numeric and calendar conventions.

* rounding is half-to-even on the scaled double (``rint``), never half-up
* ratios are NULL-safe: a zero denominator gives NULL
* weeks end on Monday, so a week is named by the Tuesday it starts on
* trailing frames never include the current row
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: ColumnLike, digits: int) -> Column:
    """Half-to-even rounding; the added 0.0 turns a negative zero into zero."""
    scale = float(10**digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num: ColumnLike, den: ColumnLike, digits: int = 4) -> Column:
    return rnd(ratio(num, den) * 100.0, digits)


def zero_sum(c: ColumnLike) -> Column:
    """Sum that is 0, not NULL, over an all-NULL group."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def week_start(d: ColumnLike) -> Column:
    shifted = F.date_trunc("week", F.date_sub(col(d), 1)).cast("date")
    return F.date_add(shifted, 1)


def series(keys: Sequence[str], order: ColumnLike = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(spec: WindowSpec, rows: int) -> WindowSpec:
    """Last ``rows`` observations, current row excluded."""
    return spec.rowsBetween(-rows, -1)


def past(spec: WindowSpec) -> WindowSpec:
    """All earlier observations, current row excluded."""
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, smallest value on ties.

    Counts per (key, value) first, so a key with a third of all rows is spread
    over its values and pre-counted on the map side.
    """
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(key)
        .agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(value))
    )


def with_ordinals(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``_nth_<column>``: which of the column's distinct values in its group a row has, from 1 (null for null).

    The largest is the number of distinct values. Rows are dealt once by ``keys``, and an aggregate by them needs no
    further shuffle, where several ``count_distinct`` would send each row once for each of them and once more.
    For groups on the grain of a fact, such as what a store sells of a SKU in a day.
    """
    nth = {f"_nth_{c}": F.when(F.col(c).isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(c).asc_nulls_last()))) for c in columns}
    return df.withColumns(nth)


def distinct_of(c: str) -> Column:
    """Number of distinct values from ``with_ordinals``."""
    return F.coalesce(F.max(f"_nth_{c}"), F.lit(0)).cast("long")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide columns to (name, value) rows without a shuffle."""
    return df.unpivot(list(ids), list(columns), name, value)
