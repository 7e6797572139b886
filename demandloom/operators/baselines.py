"""Forecasts that need no model: naive, seasonal, averages, intermittent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.recurrences import add_intermittent
from demandloom.functions.semantics import past, series, trailing
from demandloom.functions.vocabulary import ALPHA, BETA
from demandloom.operators.features import GRAIN

MODELS = (
    "naive", "seasonal_naive", "moving_average_7", "moving_average_14", "moving_average_30", "historical_mean",
)


def zero_fill(df: DataFrame, keys: Sequence[str], order: str, span: DataFrame, step: int, values: Sequence[str]) -> DataFrame:
    """Dense panel over [lo, hi]: each observation emits itself and the gap after it.

    One sort per series and no join with the calendar; the first observation also
    covers the days before it. ``span`` is a one-row (lo, hi) frame.
    """
    return fill_gaps(with_gaps(df, keys, order, span, step), keys, order, step, values)


def with_gaps(df: DataFrame, keys: Sequence[str], order: str, span: DataFrame, step: int) -> DataFrame:
    """``df`` with the days ``_from`` to ``_to`` that each observation stands for in the dense panel."""
    w = series(keys, order)
    start = F.when(F.lag(order).over(w).isNull(), span.select("lo").scalar()).otherwise(F.col(order))
    following = F.lead(order).over(w)
    end = F.when(following.isNull(), span.select("hi").scalar()).otherwise(F.date_sub(following, step))
    return df.withColumns({"_from": start, "_to": end})


def fill_gaps(df: DataFrame, keys: Sequence[str], order: str, step: int, values: Sequence[str]) -> DataFrame:
    """Dense panel from the rows of ``with_gaps``."""
    day = F.col(order)
    rows = df.withColumn("_day", F.explode(F.sequence("_from", "_to", F.expr(f"interval {step} days"))))
    filled = {v: F.when(F.col("_day") == day, F.col(v)).otherwise(F.lit(0).cast(df.schema[v].dataType)) for v in values}
    return rows.select(*keys, F.col("_day").alias(order), *[c.alias(v) for v, c in filled.items()])


def naive(w) -> Column:
    return F.lag("units_sold", 1).over(w)


def seasonal_naive(w, period: int = 7) -> Column:
    return F.lag("units_sold", period).over(w)


def moving_average(w, rows: int) -> Column:
    return F.avg("units_sold").over(trailing(w, rows))


def historical_mean(w) -> Column:
    return F.avg("units_sold").over(past(w))


def attach_baselines(panel: DataFrame, keys: Sequence[str] = GRAIN) -> DataFrame:
    """All baselines on one window sort."""
    w = series(keys)
    return panel.withColumns({
        "naive": naive(w), "seasonal_naive": seasonal_naive(w),
        **{f"moving_average_{k}": moving_average(w, k) for k in (7, 14, 30)},
        "historical_mean": historical_mean(w),
    })


def long_predictions(predictions: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """(model, prediction) rows of held-out data."""
    held_out = predictions.where(F.col("split").isin("validation", "test"))
    ids = ["source_dataset", "entity_id", "product_key", "date", "split", "units_sold", "revenue"]
    return held_out.unpivot(ids, list(models), "model", "prediction")


def multi_step(panel: DataFrame, horizon: int, window: int = 7, season: int = 7, keys: Sequence[str] = GRAIN) -> DataFrame:
    """Repeat-last, mean-of-last-w and tiled-season forecasts for h = 1..H."""
    back = F.row_number().over(series(keys, F.desc("date")))
    last = panel.withColumn("_back", back).where(F.col("_back") <= max(window, season))  # all that a forecast looks at
    packed = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "units_sold"))).alias("obs"))
    values = F.transform("obs", lambda o: o["units_sold"].cast("double"))
    n = F.size("obs")
    tail = lambda k: F.slice("v", F.greatest(n - k + 1, F.lit(1)), k)
    mean = F.aggregate(tail(window), F.lit(0.0), lambda a, x: a + x) / F.least(n, F.lit(window))
    step = F.col("step")
    tiled = F.when(n < season, F.element_at("v", -1)).otherwise(
        F.element_at(tail(season), ((step - 1) % season + 1).cast("int"))
    )
    return (
        packed.withColumn("v", values)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(*keys, "step", F.element_at("v", -1).alias("naive"), mean.alias("moving_average"), tiled.alias("seasonal_naive"))
    )


MEAN_ROWS = 7  # observations of the mean that is a forecast


def horizon_forecasts(panel: DataFrame, horizons: Sequence[int], rows: int = MEAN_ROWS) -> DataFrame:
    """Held-out forecasts per horizon from observations at least h steps old."""
    w = series(GRAIN)
    made = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"), F.lag("date", h).over(w).alias("origin_date"),
            F.avg("units_sold").over(w.rowsBetween(-(h + rows - 1), -h)).alias("prediction"),
            F.stddev_samp("units_sold").over(w.rowsBetween(-(h + rows - 1), -h)).alias("spread"),
        )
        for h in horizons
    ])
    rows_ = panel.withColumn("made", made).where(F.col("split") == "test").withColumn("m", F.explode("made"))
    return rows_.where(F.col("m.prediction").isNotNull()).select(
        *GRAIN, F.col("date").alias("forecast_date"), "m.origin_date", "m.horizon", F.col("units_sold").alias("actual"),
        "m.prediction",
        F.when(F.col("m.spread").isNotNull(), F.greatest(F.col("m.prediction") - 1.28 * F.col("m.spread"), F.lit(0.0))).alias("lower_bound"),
        (F.col("m.prediction") + 1.28 * F.col("m.spread")).alias("upper_bound"),
        F.lit("moving_average_7").alias("model_name"), F.lit("v1").alias("model_version"),
    )


def intermittent(panel: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """One-step Croston, SBA and TSB forecasts of the test period.

    The first observation of a series has no lag and is left out, as in training.
    """
    later = panel.withColumn("_n", F.row_number().over(series(GRAIN))).where(F.col("_n") > 1).drop("_n")
    rows = add_intermittent(later.select(*GRAIN, "date", "split", "units_sold"), GRAIN, "date", "units_sold", alpha, beta)
    croston = F.coalesce(F.try_divide("level", "gap"), F.lit(0.0))
    return rows.where(F.col("split") == "test").select(
        *GRAIN, "date", F.col("units_sold").alias("actual"),
        croston.alias("croston"), (croston * (1.0 - alpha / 2.0)).alias("sba"), (F.col("prob") * F.col("level")).alias("tsb"),
    )
