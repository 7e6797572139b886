"""Exact linear-interpolated quantiles without one task per group.

``percentile`` keeps a value map of the whole group in one buffer; with a source
holding a third of all rows and a continuous value that buffer is the data. Here
values are counted, the counts are dealt by ranges of (group, value), and only
the ranges that hold a wanted rank are sorted (see ``scan``).
The value counts are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.scan import running_totals
from demandloom.session import stored


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group: ``by``, ``n`` and one column per probability.

    ``by`` should have few distinct values (sources, models, features). For per-series
    quantiles, whose groups are bounded by the calendar, use ``F.percentile``.
    """
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .select(*by, v.alias("_v"))
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("_c"))
    )
    return quantiles_of_counts(stored(counts, "value-counts"), probs, by, names)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """As ``exact_quantiles`` from a stored table of ``by``, value ``_v`` and count ``_c``."""
    by = list(by)
    wanted = F.array(*[pos for p in probs for pos in _positions(p, "_end_all")])
    holds = F.exists(wanted, lambda p: (p >= F.col("_end_before")) & (p < F.col("_end_before") + F.col("_end_range")))
    ranked = running_totals(counts, by, ["_v"], {"_end": "_c"}, holds).withColumnRenamed("_end_all", "n")

    def value_at(pos):
        hit = (pos < F.col("_end")) & (pos >= F.col("_end") - F.col("_c"))
        return F.max(F.when(hit, F.col("_v")))

    picks = []
    for i, p in enumerate(probs):
        lo, hi = _positions(p, "n")
        picks += [value_at(lo).alias(f"_lo{i}"), value_at(hi).alias(f"_hi{i}")]
    out = ranked.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
    return out.select(*by, "n", *cols)


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Quantiles of several columns in one pass: ``<column>_q<i>`` per group.

    The columns become rows of one long table, so the source is planned and
    bucketed once however many columns are asked for.
    """
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "_col", "_val")
    names = [f"_q{i}" for i in range(len(probs))]
    table = exact_quantiles(long, "_val", probs, [*by, "_col"], names)
    pick = lambda c, q: F.max(F.when(F.col("_col") == c, F.col(q)))
    return table.groupBy(*by).agg(*[pick(c, q).alias(f"{c}{q}") for c in columns for q in names])


def _positions(p: float, n: str):
    pos = F.floor(F.lit(float(p)) * (F.col(n) - 1)).cast("long")
    return pos, F.least(pos + 1, F.col(n) - 1)
