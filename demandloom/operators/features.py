"""Leakage-safe time-series features.

A series is (source, entity, product) on the daily grain and (source, product)
on the weekly one. Facts are aggregated to one row per date first, which bounds
every window partition by the calendar however skewed the raw rows are. All
frames of a table share one window specification, so Spark sorts once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.recurrences import add_past_ewm
from demandloom.functions.semantics import ratio, series, trailing
from demandloom.functions.vocabulary import DAILY_LAGS, DAILY_WINDOWS, WEEKLY_LAGS, WEEKLY_SPANS, WEEKLY_WINDOWS

GRAIN = ("source_dataset", "entity_id", "product_key")
WEEKLY_GRAIN = ("source_dataset", "product_key")


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer").otherwise("Fall")
    )


def calendar_attributes(days: DataFrame, holidays: Sequence[tuple[str, int, int | None, int, int]]) -> DataFrame:
    """Calendar row per date; ``holidays``: name, month, ISO weekday or None, first and last day. The first rule that fits names a day."""
    d = F.col("date")
    name = F.lit("Regular Day")
    for label, month, weekday, first, last in reversed(holidays):
        fits = (F.month(d) == month) & F.day(d).between(first, last)
        name = F.when(fits if weekday is None else fits & (F.weekday(d) == weekday - 1), label).otherwise(name)
    return days.select(
        "date", F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.day(d).alias("day"),
        F.weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        (F.weekday(d) >= 5).cast("int").alias("is_weekend"), (name != "Regular Day").cast("int").alias("is_holiday"),
        name.alias("holiday_name"), season(F.month(d)).alias("season"), F.weekofyear(d).alias("week_of_year"),
    )


def date_parts(d: str = "date") -> dict[str, Column]:
    c = F.col(d)
    return {
        "year": F.year(c), "month": F.month(c), "quarter": F.quarter(c), "week_of_year": F.weekofyear(c),
        "day_of_week": F.weekday(c), "day_of_month": F.day(c), "day_of_year": F.dayofyear(c),
        "is_weekend": (F.weekday(c) >= 5).cast("int"),
    }


def harmonic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclical(month: Column, dow: Column) -> dict[str, Column]:
    ms, mc = harmonic(month, 12)
    ds, dc = harmonic(dow, 7)
    return {"month_sin": ms, "month_cos": mc, "dow_sin": ds, "dow_cos": dc}


def lags(keys: Sequence[str], value: str, steps: Sequence[int], order: str, prefix: str) -> dict[str, Column]:
    w = series(keys, order)
    return {f"{prefix}{k}": F.lag(value, k).over(w) for k in steps}


def rolling(keys, value, windows, order, stats, name="rolling_{stat}_{w}") -> dict[str, Column]:
    """Trailing statistics over the last w observations before the current one."""
    make = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    spec = series(keys, order)
    return {name.format(stat=s, w=w): make[s](value).over(trailing(spec, w)) for w in windows for s in stats}


def full_rolling(keys, value, windows, order, stats, name) -> dict[str, Column]:
    """As ``rolling`` but NULL until the frame holds w observations."""
    spec = series(keys, order)
    out = rolling(keys, value, windows, order, stats, name)
    return {
        name.format(stat=s, w=w): F.when(F.count(value).over(trailing(spec, w)) == w, out[name.format(stat=s, w=w)])
        for w in windows for s in stats
    }


def demand_trend() -> dict[str, Column]:
    """Changes and growth from lags and rolling means already attached."""
    def growth(w: int) -> Column:
        return (F.col(f"rolling_mean_{w}") - F.col(f"units_sold_lag_{w}")) / (F.abs(f"units_sold_lag_{w}") + 1)

    return {
        "demand_change_1": F.col("units_sold_lag_1") - F.col("units_sold_lag_2"),
        "demand_change_7": F.col("units_sold_lag_1") - F.lag("units_sold", 8).over(series(GRAIN)),
        "demand_growth_7": growth(7),
        "demand_growth_30": growth(30),
    }


def price_features() -> dict[str, Column]:
    base, price = F.col("base_price"), F.col("average_unit_price")
    before = F.lag("average_unit_price", 1).over(series(GRAIN))
    return {
        "discount_pct": F.when(base > 0, (base - price) / base),
        "price_lag_1": before,
        "price_change": price - before,
    }


def promotion_features() -> dict[str, Column]:
    return {
        "promotion_available": F.col("promotion_flag").isNotNull().cast("int"),
        "promo_rolling_7": F.avg("promotion_flag").over(trailing(series(GRAIN), 7)),
    }


def inventory_features() -> dict[str, Column]:
    """Yesterday's stock position; same-day stock would reveal the target."""
    w = series(GRAIN)
    ending = F.lag("ending_inventory", 1).over(w)
    mean = F.avg("units_sold").over(trailing(w, 7))
    return {
        "ending_inventory": ending,
        "on_order_qty": F.lag("on_order_qty", 1).over(w),
        "stockout_flag": F.lag("stockout_flag", 1).over(w),
        "historical_doi": ratio(ending, mean),
    }


def unique_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One deterministic row per key, so a lookup can never multiply rows."""
    row = F.min(F.struct(*columns))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def with_product(base: DataFrame, products: DataFrame, columns: Sequence[str]) -> DataFrame:
    return base.join(unique_by(products, ["product_key"], columns), "product_key", "left")


def with_entity(base: DataFrame, entities: DataFrame) -> DataFrame:
    cols = ["region", "store_type", "store_size_sqft"]
    return base.join(entities.select("source_dataset", "entity_id", *cols), ["source_dataset", "entity_id"], "left")


def with_stock(base: DataFrame, inventory: DataFrame) -> DataFrame:
    keys = ["date", *GRAIN]
    return base.join(inventory.select(*keys, "ending_inventory", "on_order_qty", "stockout_flag"), keys, "left")


def with_calendar(base: DataFrame, calendar: DataFrame) -> DataFrame:
    return base.join(unique_by(calendar, ["date"], ["is_holiday", "season"]), "date", "left")


def split_bounds(df: DataFrame, train: float = 0.8, validation: float = 0.9) -> DataFrame:
    """First validation and test day per source; one row per source."""
    span = df.groupBy("source_dataset").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = F.date_diff("hi", "lo")
    return span.select(
        "source_dataset",
        F.date_add("lo", F.floor(days * F.lit(train)).cast("int")).alias("val_start"),
        F.date_add("lo", F.floor(days * F.lit(validation)).cast("int")).alias("test_start"),
    )


def time_split(df: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Chronological 80/10/10 split by day span of each source; ``days``: rows with the same spans, if there are fewer."""
    marked = df.join(F.broadcast(split_bounds(df if days is None else days)), "source_dataset")
    return marked.withColumn(
        "split",
        F.when(F.col("date") < F.col("val_start"), "train").when(F.col("date") < F.col("test_start"), "validation").otherwise("test"),
    ).drop("val_start", "test_start")


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source_dataset", "split").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("rows"),
        F.count_distinct("entity_id").alias("unique_entities"), F.count_distinct("product_key").alias("unique_products"),
    )


def daily_features(base, products, entities, inventory, calendar) -> DataFrame:
    """All daily features: lookups first, then every frame on one sort."""
    df = with_product(base, products, ["category", "sub_category", "brand", "base_price"])
    df = with_calendar(with_entity(with_stock(df, inventory), entities), calendar)
    df = df.withColumns(date_parts())
    df = df.withColumns(cyclical(F.col("month"), F.col("day_of_week")))
    df = df.withColumns({
        **lags(GRAIN, "units_sold", DAILY_LAGS, "date", "units_sold_lag_"),
        **rolling(GRAIN, "units_sold", DAILY_WINDOWS, "date", ("mean", "std")),
        **price_features(), **promotion_features(), **inventory_features(),
    })
    df = df.withColumns(demand_trend())
    df = df.withColumn("insufficient_history", F.col("units_sold_lag_1").isNull().cast("int"))
    return time_split(df)


def legacy_matrix(sales, skus, stores, calendar, keys=("store_id", "sku_id"), drop_incomplete=True) -> DataFrame:
    """Older feature matrix: full windows only, min/max/EWM, clipped discount."""
    df = (
        sales.join(skus.select("sku_id", "category", "base_price"), "sku_id", "left")
        .join(stores.select("store_id", "region", "store_type"), "store_id", "left")
        .join(calendar.select("date", "is_holiday", "season"), "date", "left")
    )
    d = F.col("date")
    parts = date_parts()
    sin_d, cos_d = harmonic(F.weekday(d), 7)
    sin_m, cos_m = harmonic(F.month(d), 12)
    cut = F.greatest(F.lit(0.0), F.col("base_price") - F.col("avg_unit_price"))
    df = df.withColumns({
        **parts,
        "is_month_start": (F.day(d) == 1).cast("int"), "is_month_end": (d == F.last_day(d)).cast("int"),
        "sin_day_of_week": sin_d, "cos_day_of_week": cos_d, "sin_month": sin_m, "cos_month": cos_m,
        "price_discount": cut, "discount_pct": F.when(F.col("base_price") > 0, cut / F.col("base_price")).otherwise(0.0),
        **lags(keys, "units_sold", DAILY_LAGS, "date", "units_sold_lag_"),
        **full_rolling(keys, "units_sold", DAILY_WINDOWS, "date", ("mean", "std", "min", "max"), "units_sold_rolling_{stat}_{w}"),
    })
    df = add_past_ewm(df, keys, "date", "units_sold", {"units_sold_ewm_7": 7, "units_sold_ewm_28": 28})
    return df.na.drop() if drop_incomplete else df


def weekly_features(weekly: DataFrame) -> DataFrame:
    """Weekly lags, trailing statistics, EWM, harmonics and lagged price/promo."""
    keys, w = WEEKLY_GRAIN, series(WEEKLY_GRAIN, "week")
    week = F.col("week")
    sin_w, cos_w = harmonic(F.weekofyear(week), 52)
    sin_m, cos_m = harmonic(F.month(week), 12)
    stats = rolling(keys, "units_sold", WEEKLY_WINDOWS, "week", ("mean", "std", "min", "max"))
    stats = {k: F.coalesce(v, F.lit(0.0)) if "_std_" in k else v for k, v in stats.items()}
    df = weekly.withColumns({
        **lags(keys, "units_sold", WEEKLY_LAGS, "week", "lag_"), **stats,
        "price_lag1": F.lag("avg_unit_price", 1).over(w),
        "promo_lag1": F.coalesce(F.lag("promotion_flag", 1).over(w), F.lit(0)).cast("int"),
        "week_of_year": F.weekofyear(week), "month": F.month(week), "quarter": F.quarter(week), "year": F.year(week),
        "sin_week": sin_w, "cos_week": cos_w, "sin_month": sin_m, "cos_month": cos_m,
    })
    return add_past_ewm(df, keys, "week", "units_sold", {f"ewm_{s}": s for s in WEEKLY_SPANS})


def holiday_proximity(weekly_calendar: DataFrame) -> DataFrame:
    """Weeks to the next and since the last holiday week; 52 when there is none.

    One row per calendar week, so the ordered window is bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("week")
    mark = F.when(F.col("is_holiday_week") == 1, F.col("week"))
    following = F.min(mark).over(w.rowsBetween(1, Window.unboundedFollowing))
    previous = F.max(mark).over(w.rowsBetween(Window.unboundedPreceding, 0))
    weeks = lambda days: F.floor(days / 7).cast("int")
    return weekly_calendar.withColumns({
        "weeks_to_next_holiday": F.coalesce(weeks(F.date_diff(following, F.col("week"))), F.lit(52)),
        "weeks_since_last_holiday": F.coalesce(weeks(F.date_diff(F.col("week"), previous)), F.lit(52)),
    })


def with_holidays(weekly: DataFrame, weekly_calendar: DataFrame) -> DataFrame:
    near = holiday_proximity(weekly_calendar).select(
        "week", "is_holiday_week", "holiday_count", "season", "season_Winter", "season_Spring", "season_Summer",
        "season_Fall", "weeks_to_next_holiday", "weeks_since_last_holiday",
    )
    joined = weekly.join(near, "week", "left")
    return joined.withColumns({
        "is_holiday_week": F.coalesce("is_holiday_week", F.lit(0)),
        "holiday_count": F.coalesce("holiday_count", F.lit(0)),
        "holiday_x_promo": F.coalesce("is_holiday_week", F.lit(0)) * F.col("promo_lag1"),
    })


def direct_panel(panel: DataFrame, horizons: Sequence[int], calendar_columns: Sequence[str] = ()) -> DataFrame:
    """Row per origin and horizon with the target h steps ahead and its role.

    A row trains only if its target still lies in the training period.
    """
    w = series(GRAIN)
    ahead = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"), F.lead("units_sold", h).over(w).alias("target"), F.lead("date", h).over(w).alias("target_date"),
            *[F.lead(c, h).over(w).alias(f"hcal_{c}") for c in calendar_columns],
        )
        for h in horizons
    ])
    ends = panel.groupBy("source_dataset").agg(
        F.max(F.when(F.col("split") == "train", F.col("date"))).alias("train_end"),
        F.max(F.when(F.col("split") == "validation", F.col("date"))).alias("val_end"),
    )
    rows = panel.withColumn("ahead", ahead).select("*", F.explode("ahead").alias("a")).drop("ahead").select("*", "a.*").drop("a")
    rows = rows.where(F.col("target").isNotNull()).join(F.broadcast(ends), "source_dataset")
    role = (
        F.when((F.col("split") == "train") & (F.col("target_date") <= F.col("train_end")), "train")
        .when((F.col("split") == "validation") & (F.col("target_date") <= F.col("val_end")), "validation")
        .when(F.col("split") == "test", "test")
    )
    return rows.withColumn("role", role).drop("train_end", "val_end")


def frequency_encoding(df: DataFrame, column: str, train: Column) -> DataFrame:
    """Share of the training rows with the same level; 0 for unseen levels."""
    level = F.coalesce(F.col(column), F.lit("__missing__"))
    seen = df.where(train).groupBy(level.alias("_level")).agg(F.count("*").alias("_n"))
    total = seen.agg(F.sum("_n").alias("t"))
    share = seen.select("_level", (F.col("_n") / total.select("t").scalar()).alias(f"{column}_freq"))
    joined = df.withColumn("_level", level).join(share, "_level", "left").drop("_level")
    return joined.withColumn(f"{column}_freq", F.coalesce(f"{column}_freq", F.lit(0.0)))
