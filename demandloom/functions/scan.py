"""Running totals over ordered groups without one task per group.

Rows are dealt by ranges of (group, order), so that a group with a third of all rows, and with a key in the order also
a value with a third of them, is spread evenly. Each range is added up once; what came before a range in its group is
carried over from these few rows, and the running totals of a range are taken in its own task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import stored

RANGE_ROWS = 50_000


def ranges_of(table: DataFrame) -> int:
    """Ranges for a stored table: about RANGE_ROWS rows each, and enough to spread small tables."""
    at_hand = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table.count()
    return max(1, min(at_hand, rows // 1000), rows // RANGE_ROWS)


def running_totals(table: DataFrame, by: Sequence[str], order: Sequence[Column | str], totals: Mapping[str, str], needed: Column | None = None) -> DataFrame:
    """``table`` (stored: it is read twice) with, for each entry (name, column) of ``totals``, three columns more.

    ``name``: sum of the column up to and with the row; ``name_all``: its sum over the group; ``name_before``: its sum over
    earlier ranges, for use in ``needed``. Rows that ``order`` does not tell apart follow each other in any order. Null groups
    are groups. ``needed``: of a range, by the columns ``name_before``, ``name_range`` and ``name_all``; rows of other
    ranges are left out before anything is sorted.
    """
    by = list(by)
    placed = stored(table.repartitionByRange(ranges_of(table), *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"{name}_range") for name, c in totals.items()])
    # a row for each range and group that meet: their number is that of ranges and groups
    earlier, whole = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    carried = sums.withColumns({
        **{f"{name}_before": F.coalesce(F.sum(f"{name}_range").over(earlier), F.lit(0)) for name in totals},
        **{f"{name}_all": F.sum(f"{name}_range").over(whole) for name in totals},
    })
    if needed is not None:
        carried = carried.where(needed)
    keys = [*by, "_range"]
    carried = carried.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], *[f"{name}_{part}" for name in totals for part in ("before", "all")])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(carried, same).drop(*[f"_of_{i}" for i in range(len(keys))])
    return rows.withColumns({name: F.col(f"{name}_before") + F.sum(c).over(inside) for name, c in totals.items()}).drop("_range")
