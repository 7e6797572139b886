"""Rolling-origin backtests over weekly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.semantics import series, trailing
from demandloom.functions.vocabulary import (
    BACKTEST_FOLDS, BACKTEST_HORIZON, MIN_HISTORY_WEEKS, MIN_TRAIN_ROWS, SEASON_WEEKS,
)


def fold_weeks(weekly: DataFrame, folds=BACKTEST_FOLDS, horizon=BACKTEST_HORIZON, history=MIN_HISTORY_WEEKS) -> DataFrame:
    """(source, week, fold, origin) of every target week; at most folds x horizon rows per source.

    Windows here run over the distinct weeks of a source, not over its rows.
    """
    by_source = Window.partitionBy("source_dataset")
    weeks = weekly.select("source_dataset", "week").distinct().withColumns({
        "idx": F.row_number().over(by_source.orderBy("week")) - 1,
        "n": F.count(F.lit(1)).over(by_source),
    })
    allowed = F.when(F.col("n") < history + horizon + folds, F.greatest(F.lit(1), F.col("n") - history - horizon)).otherwise(folds)
    back = F.col("n") - horizon - F.col("idx")
    origins = weeks.where((back >= 0) & (back < allowed) & (F.col("idx") >= history)).select(
        "source_dataset", F.col("week").alias("origin"), F.col("idx").alias("origin_idx"),
        (F.row_number().over(by_source.orderBy("week")) - 1).alias("fold"),
    )
    steps = F.sequence(F.col("origin_idx") + 1, F.col("origin_idx") + horizon)
    targets = origins.withColumn("idx", F.explode(steps))
    return targets.join(weeks.select("source_dataset", "idx", "week"), ["source_dataset", "idx"]).select(
        "source_dataset", "week", "fold", "origin"
    )


def rolling_origin(weekly: DataFrame, candidate_rows: int = 4) -> DataFrame:
    """Seasonal naive and a moving-average candidate on every fold and series.

    Target weeks directly follow the origin, so a target's training length is its
    position minus its step, and the value 52 positions before it is the seasonal
    one. That makes the fold x series loop two windows over one partitioning.
    """
    keys = ["source_dataset", "product_key"]
    w = series(keys, "week")
    placed = weekly.select(
        *keys, "week", F.col("units_sold").cast("double").alias("actual"), F.row_number().over(w).alias("pos"),
        F.lag("units_sold", SEASON_WEEKS).over(w).cast("double").alias("season_ago"),
        F.lag("units_sold", 1).over(w).cast("double").alias("before"),
        F.avg("units_sold").over(trailing(w, candidate_rows)).alias("recent"),
    )
    targets = placed.join(F.broadcast(fold_weeks(weekly)), ["source_dataset", "week"])
    fold = Window.partitionBy(*keys, "fold").orderBy("week")
    opened = fold.rowsBetween(Window.unboundedPreceding, 0)
    rows = targets.withColumns({
        "horizon_step": F.row_number().over(fold),
        "last_train": F.first("before").over(opened),
        "candidate": F.first("recent").over(opened),
    })
    return rows.where(F.col("pos") - F.col("horizon_step") >= MIN_TRAIN_ROWS).select(
        *keys, "fold", F.col("origin").alias("forecast_origin"), F.col("week").alias("forecast_week"), "horizon_step", "actual",
        F.greatest(F.lit(0.0), F.coalesce("season_ago", "last_train")).alias("seasonal_naive_forecast"),
        F.greatest(F.lit(0.0), "candidate").alias("candidate_forecast"),
    )


def expanding_folds(panel: DataFrame, count: int = 4, validation_days: int = 90) -> DataFrame:
    """Date specs of expanding folds, newest last: train up to ``train_end``."""
    span = panel.groupBy("source_dataset").agg(F.max("date").alias("hi"))
    spec = span.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    back = (count - F.col("k")) * validation_days
    return spec.select(
        "source_dataset", F.col("k").alias("fold"), F.date_sub("hi", back).alias("train_end"),
        F.date_add(F.date_sub("hi", back), 1).alias("val_start"), F.date_sub("hi", back - validation_days).alias("val_end"),
    )


def walk_forward(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the fold they take part in and their role there."""
    rows = panel.join(F.broadcast(folds), "source_dataset").where(F.col("date") <= F.col("val_end"))
    return rows.withColumn("role", F.when(F.col("date") <= F.col("train_end"), "train").otherwise("validation"))
