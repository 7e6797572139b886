"""Feature queries."""

from pyspark.sql import functions as F

from demandloom.functions.recurrences import add_past_ewm
from demandloom.functions.semantics import rnd
from demandloom.functions.vocabulary import DAILY_LAGS, DAILY_WINDOWS, HORIZONS, WEEKLY_LAGS, WEEKLY_SPANS, WEEKLY_WINDOWS
from demandloom.operators import features
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, pct, r
from demandloom.plans.views import SPLIT

KEY = ["date", "source_dataset", "entity_id", "product_key"]
K = ", ".join(KEY)
P = "PARTITION BY source_dataset, entity_id, product_key ORDER BY date"
PI = "3.141592653589793"


def before(w, fn="avg", c="units_sold", p=P):
    return f"{fn}({c}) OVER ({p} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


PARTS = """CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
 CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend"""


@query("f1_calendar_features", f"SELECT {K}, {PARTS} FROM fact_sales")
def f1(t):
    return t.fact_sales.select(*KEY).withColumns(features.date_parts())


def _wave(fn, part, period):
    return r(f"{fn}(2 * CAST({PI} AS DOUBLE) * {part} / {period})", 9)


@query("f2_cyclical_features", f"""
SELECT {K}, {_wave('sin', 'month(date)', 12)} AS month_sin, {_wave('cos', 'month(date)', 12)} AS month_cos, {_wave('sin', '(isodow(date) - 1)', 7)} AS dow_sin, {_wave('cos', '(isodow(date) - 1)', 7)} AS dow_cos FROM fact_sales""")
def f2(t):
    made = features.cyclical(F.month("date"), F.weekday("date"))
    return t.fact_sales.select(*KEY, *[rnd(c, 9).alias(n) for n, c in made.items()])


LAGS = ", ".join(f"lag(units_sold, {k}) OVER w AS units_sold_lag_{k}" for k in DAILY_LAGS)


@query("f3_lag_features", f"SELECT {K}, {LAGS} FROM fact_sales WINDOW w AS ({P})")
def f3(t):
    made = features.lags(features.GRAIN, "units_sold", DAILY_LAGS, "date", "units_sold_lag_")
    return t.fact_sales.select(*KEY, *[c.alias(n) for n, c in made.items()])


ROLL = ", ".join(f"{r(before(w), 6)} AS rolling_mean_{w}, {r(before(w, 'stddev_samp'), 6)} AS rolling_std_{w}" for w in DAILY_WINDOWS)


@query("f4_rolling_features", f"SELECT {K}, {ROLL} FROM fact_sales")
def f4(t):
    made = features.rolling(features.GRAIN, "units_sold", DAILY_WINDOWS, "date", ("mean", "std"))
    return t.fact_sales.select(*KEY, *[rnd(c, 6).alias(n) for n, c in made.items()])


TREND = f"""lag(units_sold, 1) OVER w - lag(units_sold, 2) OVER w AS demand_change_1, lag(units_sold, 1) OVER w - lag(units_sold, 8) OVER w AS demand_change_7,
 {r(f'({before(7)} - lag(units_sold, 7) OVER w) / (abs(lag(units_sold, 7) OVER w) + 1)', 6)} AS demand_growth_7, {r(f'({before(30)} - lag(units_sold, 30) OVER w) / (abs(lag(units_sold, 30) OVER w) + 1)', 6)} AS demand_growth_30"""


@query("f5_demand_trend", f"SELECT {K}, {TREND} FROM fact_sales WINDOW w AS ({P})")
def f5(t):
    df = t.fact_sales.withColumns({
        **features.lags(features.GRAIN, "units_sold", (1, 2, 7, 30), "date", "units_sold_lag_"), **features.rolling(features.GRAIN, "units_sold", (7, 30), "date", ("mean",))})
    made = features.demand_trend()
    return df.select(*KEY, *[(rnd(c, 6) if "growth" in n else c).alias(n) for n, c in made.items()])


PRICE = f"""{r('CASE WHEN base_price > 0 THEN (base_price - average_unit_price) / base_price END', 6)} AS discount_pct, {r('lag(average_unit_price, 1) OVER w', 6)} AS price_lag_1,
 {r('average_unit_price - lag(average_unit_price, 1) OVER w', 6)} AS price_change"""
WITH_PRICE = "(SELECT f.*, base_price, category, sub_category, brand FROM fact_sales f LEFT JOIN dim_product p ON f.product_key = p.product_key) x"


@query("f6_price_features", f"SELECT {K}, {PRICE} FROM {WITH_PRICE} WINDOW w AS ({P})")
def f6(t):
    df = features.with_product(t.fact_sales, t.dim_product, ["base_price"])
    return df.select(*KEY, *[rnd(c, 6).alias(n) for n, c in features.price_features().items()])


@query("f7_promotion_features", f"SELECT {K}, CASE WHEN promotion_flag IS NULL THEN 0 ELSE 1 END AS promotion_available, {r(before(7, c='promotion_flag'), 6)} AS promo_rolling_7 FROM fact_sales")
def f7(t):
    made = features.promotion_features()
    return t.fact_sales.select(*KEY, made["promotion_available"].alias("promotion_available"), rnd(made["promo_rolling_7"], 6).alias("promo_rolling_7"))


@query("f8_product_attributes", f"SELECT {K}, category, sub_category, brand FROM {WITH_PRICE}")
def f8(t):
    return features.with_product(t.fact_sales.select(*KEY), t.dim_product, ["category", "sub_category", "brand"])


@query("f9_entity_attributes", """
SELECT f.date, f.source_dataset, f.entity_id, f.product_key, region, store_type, store_size_sqft FROM fact_sales f LEFT JOIN dim_entity e ON f.entity_id = e.entity_id AND f.source_dataset = e.source_dataset""")
def f9(t):
    return features.with_entity(t.fact_sales.select(*KEY), t.dim_entity)


STOCK_JOIN = """(SELECT f.*, ending_inventory AS inv_end, on_order_qty AS inv_order, stockout_flag AS inv_out FROM fact_sales f LEFT JOIN fact_inventory i ON f.date = i.date AND f.source_dataset = i.source_dataset
 AND f.entity_id = i.entity_id AND f.product_key = i.product_key) x"""


@query("f10_inventory_features", f"""
SELECT {K}, lag(inv_end, 1) OVER w AS ending_inventory, lag(inv_order, 1) OVER w AS on_order_qty, lag(inv_out, 1) OVER w AS stockout_flag, {r(f'lag(inv_end, 1) OVER w / NULLIF({before(7)}, 0)', 6)} AS historical_doi
FROM {STOCK_JOIN} WINDOW w AS ({P})""")
def f10(t):
    df = features.with_stock(t.fact_sales, t.fact_inventory)
    made = features.inventory_features()
    return df.select(*KEY, *[(rnd(c, 6) if n == "historical_doi" else c).alias(n) for n, c in made.items()])


@query("f11_holiday_join", "SELECT f.date, f.source_dataset, f.entity_id, f.product_key, is_holiday, season FROM fact_sales f LEFT JOIN dim_calendar c ON f.date = c.date")
def f11(t):
    return features.with_calendar(t.fact_sales.select(*KEY), t.dim_calendar)


def _split(table):
    return SPLIT.format(t=table)


@query("f12_time_split", f"""
SELECT source_dataset, split, min(date) AS start_date, max(date) AS end_date, count(*) AS rows, count(DISTINCT entity_id) AS unique_entities, count(DISTINCT product_key) AS unique_products
FROM ({_split('fact_sales')}) s GROUP BY 1, 2""")
def f12(t):
    return features.split_summary(features.time_split(t.fact_sales))


@query("f13_history_flags", f"""
SELECT source_dataset, {big('sum(CASE WHEN l1 IS NULL THEN 1 ELSE 0 END)')} AS insufficient_history, count(*) AS rows, count(*) - count(l7) AS missing_lag_7, {pct('count(*) - count(l7)', 'count(*)', 2)} AS missing_lag_7_pct,
 count(*) - count(l30) AS missing_lag_30, {pct('count(*) - count(l30)', 'count(*)', 2)} AS missing_lag_30_pct FROM (SELECT source_dataset, lag(units_sold, 1) OVER w AS l1, lag(units_sold, 7) OVER w AS l7,
 lag(units_sold, 30) OVER w AS l30 FROM fact_sales WINDOW w AS ({P})) x GROUP BY 1""")
def f13(t):
    df = t.fact_sales.withColumns(features.lags(features.GRAIN, "units_sold", (1, 7, 30), "date", "l"))
    gap = lambda c: F.count("*") - F.count(c)
    share = lambda c: rnd((F.count("*") - F.count(c)) / F.count("*") * 100.0, 2)
    return df.groupBy("source_dataset").agg(
        gap("l1").alias("insufficient_history"), F.count("*").alias("rows"), gap("l7").alias("missing_lag_7"), share("l7").alias("missing_lag_7_pct"),
        gap("l30").alias("missing_lag_30"), share("l30").alias("missing_lag_30_pct"))


F14 = f"""SELECT {K}, units_sold, category, region, store_type, is_holiday, season, {LAGS}, {ROLL}, {TREND}, {PRICE}, {r(before(7, c='promotion_flag'), 6)} AS promo_rolling_7, lag(inv_end, 1) OVER w AS ending_inventory,
 {r(f'lag(inv_end, 1) OVER w / NULLIF({before(7)}, 0)', 6)} AS historical_doi, CASE WHEN lag(units_sold, 1) OVER w IS NULL THEN 1 ELSE 0 END AS insufficient_history, split
FROM (SELECT x.*, base_price, category, region, store_type, is_holiday, season, i.ending_inventory AS inv_end FROM ({_split('fact_sales')}) x
 LEFT JOIN dim_product p ON x.product_key = p.product_key LEFT JOIN dim_entity e ON x.entity_id = e.entity_id AND x.source_dataset = e.source_dataset LEFT JOIN dim_calendar c ON x.date = c.date
 LEFT JOIN fact_inventory i ON x.date = i.date AND x.source_dataset = i.source_dataset AND x.entity_id = i.entity_id AND x.product_key = i.product_key) y WINDOW w AS ({P})"""


@query("f14_daily_feature_table", F14)
def f14(t):
    df = features.daily_features(t.forecast_base, t.dim_product, t.dim_entity, t.fact_inventory, t.dim_calendar)
    exact = ["units_sold", "category", "region", "store_type", "is_holiday", "season", *[f"units_sold_lag_{k}" for k in DAILY_LAGS], "demand_change_1", "demand_change_7", "ending_inventory",
             "insufficient_history", "split"]
    rounded = [*[f"rolling_{s}_{w}" for w in DAILY_WINDOWS for s in ("mean", "std")], "demand_growth_7", "demand_growth_30", "discount_pct", "price_lag_1", "price_change", "promo_rolling_7", "historical_doi"]
    return df.select(*KEY, *exact, *[rnd(c, 6).alias(c) for c in rounded])


def ewm(value, span, p):
    """Adjusted EWM of earlier values in closed form over row positions."""
    keep = f"CAST({1.0 - 2.0 / (span + 1.0)!r} AS DOUBLE)"
    w = f"({p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"sum({value} * pow({keep}, -pos)) OVER {w} / sum(pow({keep}, -pos)) OVER {w}"


PS = "PARTITION BY store_id, sku_id ORDER BY date"


def full(w, fn):
    frame = f"OVER ({PS} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(units_sold) {frame} = {w} THEN {fn}(units_sold) {frame} END"


FULL = ", ".join(f"{r(full(w, fn), 6)} AS units_sold_rolling_{n}_{w}" for w in DAILY_WINDOWS for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("f15_legacy_matrix", f"""
WITH p AS (SELECT date, store_id, sku_id, units_sold, avg_unit_price, row_number() OVER ({PS}) AS pos FROM sales_daily)
SELECT date, store_id, sku_id, CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end,
 {r('CASE WHEN base_price > 0 THEN greatest(0, base_price - avg_unit_price) / base_price ELSE 0 END', 6)} AS discount_pct, {FULL},
 {r(ewm('units_sold', 7, PS), 6)} AS units_sold_ewm_7, {r(ewm('units_sold', 28, PS), 6)} AS units_sold_ewm_28
FROM (SELECT p.*, base_price FROM p LEFT JOIN sku_master k ON p.sku_id = k.sku_id) x""")
def f15(t):
    df = features.legacy_matrix(t.sales_daily, t.sku_master, t.store_master, t.calendar, drop_incomplete=False)
    names = [f"units_sold_rolling_{s}_{w}" for w in DAILY_WINDOWS for s in ("mean", "std", "min", "max")] + ["units_sold_ewm_7", "units_sold_ewm_28", "discount_pct"]
    return df.select("date", "store_id", "sku_id", "is_month_start", "is_month_end", *[rnd(c, 6).alias(c) for c in names])


PW = "PARTITION BY source_dataset, product_key ORDER BY week"
WLAGS = ", ".join(f"lag(units_sold, {k}) OVER w AS lag_{k}" for k in WEEKLY_LAGS)
WROLL = ", ".join(
    f"{r(before(w, fn, p=PW) if n != 'std' else f'COALESCE({before(w, fn, p=PW)}, 0)', 6)} AS rolling_{n}_{w}"
    for w in WEEKLY_WINDOWS for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
WEWM = ", ".join(f"{r(ewm('units_sold', s, PW), 6)} AS ewm_{s}" for s in WEEKLY_SPANS)
POSITIONED = "(SELECT *, row_number() OVER (PARTITION BY source_dataset, product_key ORDER BY week) AS pos FROM weekly_demand) x"


@query("f16_weekly_features", f"""
SELECT week, source_dataset, product_key, units_sold, {WLAGS}, {WROLL}, {WEWM}, {r('lag(avg_unit_price, 1) OVER w', 6)} AS price_lag1, COALESCE(lag(promotion_flag, 1) OVER w, 0) AS promo_lag1,
 CAST(weekofyear(week) AS INTEGER) AS week_of_year, {_wave('sin', 'weekofyear(week)', 52)} AS sin_week, {_wave('cos', 'month(week)', 12)} AS cos_month FROM {POSITIONED} WINDOW w AS ({PW})""")
def f16(t):
    df = features.weekly_features(t.weekly_demand)
    rolled = [f"rolling_{s}_{w}" for w in WEEKLY_WINDOWS for s in ("mean", "std", "min", "max")] + [f"ewm_{s}" for s in WEEKLY_SPANS] + ["price_lag1"]
    return df.select("week", "source_dataset", "product_key", "units_sold", *[f"lag_{k}" for k in WEEKLY_LAGS], *[rnd(c, 6).alias(c) for c in rolled], "promo_lag1", "week_of_year",
                     rnd("sin_week", 9).alias("sin_week"), rnd("cos_month", 9).alias("cos_month"))


@query("f17_holiday_proximity", f"""
SELECT d.week, source_dataset, product_key, COALESCE(is_holiday_week, 0) AS is_holiday_week, {big('COALESCE(holiday_count, 0)')} AS holiday_count, season, CAST(COALESCE(floor((nxt - d.week) / 7), 52) AS INTEGER) AS weeks_to_next_holiday,
 CAST(COALESCE(floor((d.week - prv) / 7), 52) AS INTEGER) AS weeks_since_last_holiday, COALESCE(is_holiday_week, 0) * COALESCE(lag(promotion_flag, 1) OVER ({PW.replace('week', 'd.week')}), 0) AS holiday_x_promo
FROM weekly_demand d LEFT JOIN (SELECT week, is_holiday_week, holiday_count, season, (SELECT min(n.week) FROM weekly_calendar n WHERE n.is_holiday_week = 1 AND n.week > c.week) AS nxt,
 (SELECT max(n.week) FROM weekly_calendar n WHERE n.is_holiday_week = 1 AND n.week <= c.week) AS prv FROM weekly_calendar c) c ON d.week = c.week""")
def f17(t):
    w = features.series(features.WEEKLY_GRAIN, "week")
    weekly = t.weekly_demand.withColumn("promo_lag1", F.coalesce(F.lag("promotion_flag", 1).over(w), F.lit(0)))
    return features.with_holidays(weekly, t.weekly_calendar).select(
        "week", "source_dataset", "product_key", "is_holiday_week", "holiday_count", "season", "weeks_to_next_holiday", "weeks_since_last_holiday", "holiday_x_promo")


def _ahead(h):
    return f"SELECT source_dataset, split, {h} AS horizon, lead(units_sold, {h}) OVER w AS target, lead(date, {h}) OVER w AS target_date, month(lead(date, {h}) OVER w) AS hcal_month FROM s WINDOW w AS ({P})"


@query("f18_direct_panel", f"""
WITH s AS ({_split('fact_sales')}), e AS (SELECT source_dataset, max(CASE WHEN split = 'train' THEN date END) AS te, max(CASE WHEN split = 'validation' THEN date END) AS ve FROM s GROUP BY 1)
SELECT x.source_dataset, horizon, CASE WHEN split = 'train' AND target_date <= te THEN 'train' WHEN split = 'validation' AND target_date <= ve THEN 'validation' WHEN split = 'test' THEN 'test' END AS role,
 count(*) AS rows, {big('sum(target)')} AS target_sum, {big('sum(hcal_month)')} AS month_sum, min(target_date) AS first_target, max(target_date) AS last_target
FROM ({' UNION ALL '.join(_ahead(h) for h in HORIZONS)}) x JOIN e ON x.source_dataset = e.source_dataset WHERE target IS NOT NULL GROUP BY 1, 2, 3""")
def f18(t):
    base = features.time_split(t.fact_sales).withColumn("month", F.month("date"))
    panel = features.direct_panel(base, HORIZONS, ["month"])
    return panel.groupBy("source_dataset", "horizon", "role").agg(
        F.count("*").alias("rows"), F.sum("target").alias("target_sum"), F.sum("hcal_month").alias("month_sum"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"))


@query("f19_frequency_encoding", f"""
WITH s AS ({_split('fact_sales')}),
 j AS (SELECT s.*, COALESCE(region, '__missing__') AS level FROM s LEFT JOIN dim_entity e ON s.entity_id = e.entity_id AND s.source_dataset = e.source_dataset),
 f AS (SELECT level, count(*) / CAST((SELECT count(*) FROM j WHERE split = 'train') AS DOUBLE) AS freq FROM j WHERE split = 'train' GROUP BY 1)
SELECT NULLIF(j.level, '__missing__') AS region, split, count(*) AS rows, {r('max(COALESCE(freq, 0))', 6)} AS region_freq FROM j LEFT JOIN f ON j.level = f.level GROUP BY 1, 2""")
def f19(t):
    df = features.with_entity(features.time_split(t.fact_sales), t.dim_entity)
    enc = features.frequency_encoding(df, "region", F.col("split") == "train")
    return enc.groupBy("region", "split").agg(F.count("*").alias("rows"), rnd(F.max("region_freq"), 6).alias("region_freq"))


@query("a43_past_ewm", f"SELECT date, source_dataset, entity_id, product_key, {r(ewm('units_sold', 7, P), 6)} AS ewm_7 FROM (SELECT *, row_number() OVER ({P}) AS pos FROM fact_sales) x")
def a43(t):
    df = add_past_ewm(t.fact_sales.select(*KEY, "units_sold"), features.GRAIN, "date", "units_sold", {"ewm_7": 7})
    return df.select(*KEY, rnd("ewm_7", 6).alias("ewm_7"))
