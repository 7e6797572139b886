"""Business KPIs and exploratory aggregates.

Facts are reduced to the reporting grain before any join with attributes, so
the joins move aggregates. Shares over a total use a one-row scalar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.quantiles import exact_quantiles
from demandloom.functions.semantics import ratio, rnd
from demandloom.operators.metrics import running_share
from demandloom.operators.risk import latest

N = "*"


def total(df: DataFrame, c: str) -> Column:
    return df.agg(F.sum(c).alias("t")).select("t").scalar()


def executive(sales: DataFrame, inventory: DataFrame, skus: DataFrame, stores: DataFrame) -> DataFrame:
    stock = latest(inventory, "date").join(skus.select("sku_id", "cost_price", "safety_stock", "reorder_point"), "sku_id", "left")
    end = F.col("ending_inventory")
    row = stock.agg(
        F.sum(end).alias("total_inventory_units"), rnd(F.sum(end * F.col("cost_price")), 4).alias("total_inventory_value"),
        F.sum("stockout_flag").alias("current_stockout_count"), rnd(F.avg("stockout_flag") * 100.0, 4).alias("current_stockout_rate_pct"),
        F.count_if(end <= F.col("reorder_point")).alias("reorder_triggered_count"), F.count_if(end < F.col("safety_stock")).alias("safety_stock_breaches"),
        F.max("date").alias("latest_date"),
    )
    sold = sales.agg(
        rnd(F.sum("total_revenue"), 4).alias("a"), F.sum("units_sold").alias("b"), F.sum("transaction_count").alias("c"), F.count_distinct("sku_id").alias("d")
    ).select(F.struct("a", "b", "c", "d").alias("s")).scalar()
    count = lambda d: d.agg(F.count(N).alias("n")).select("n").scalar()
    row = row.withColumns({"_s": sold, "total_stores": count(stores), "total_skus": count(skus)})
    return row.withColumns({
        "total_revenue": F.col("_s.a"), "total_units_sold": F.col("_s.b"), "total_transactions": F.col("_s.c"), "active_skus": F.col("_s.d"),
    }).drop("_s")


def sku_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("sku_id").agg(
        F.sum("units_sold").alias("total_units"), rnd(F.sum("total_revenue"), 4).alias("total_revenue"),
        rnd(F.avg("avg_unit_price"), 4).alias("avg_price"), F.count_distinct("date").alias("active_days"),
    )


def ranked_skus(sales: DataFrame, skus: DataFrame, n: int, best: bool) -> DataFrame:
    order = F.desc("total_revenue") if best else F.asc("total_revenue")
    top = sku_totals(sales).orderBy(order, "sku_id").limit(n)
    base, cost = F.col("base_price"), F.col("cost_price")
    return top.join(skus.select("sku_id", "sku_name", "category", "brand", "cost_price", "base_price"), "sku_id", "left").withColumn(
        "margin_pct", rnd(ratio(base - cost, base) * 100.0, 4)
    ).drop("cost_price", "base_price")


def by_store_attributes(sales: DataFrame, stores: DataFrame, by: Sequence[str]) -> DataFrame:
    per_store = sales.groupBy("store_id").agg(
        F.sum("total_revenue").alias("r"), F.sum("units_sold").alias("u"), F.sum("avg_unit_price").alias("p"), F.count("avg_unit_price").alias("k")
    )
    joined = per_store.join(stores.select("store_id", *by), "store_id", "left")
    return joined.groupBy(*by).agg(
        rnd(F.sum("r"), 4).alias("total_revenue"), F.sum("u").alias("total_units"), rnd(ratio(F.sum("p"), F.sum("k")), 4).alias("avg_price"),
        F.count(N).alias("stores"),
    )


def monthly_seasonality(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.month("date").alias("month")).agg(rnd(F.sum("total_revenue"), 4).alias("total_revenue"), F.sum("units_sold").alias("total_units"))


def holiday_uplift(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean units on holidays over other days; sums per day before the join."""
    daily = sales.groupBy("date").agg(F.sum("units_sold").alias("u"), F.count(N).alias("k")).join(calendar.select("date", "is_holiday"), "date", "left")
    mean = lambda v: ratio(F.sum(F.when(F.col("is_holiday") == v, F.col("u"))), F.sum(F.when(F.col("is_holiday") == v, F.col("k"))))
    hol, normal = F.coalesce(mean(1), F.lit(0.0)), F.coalesce(mean(0), F.lit(1.0))
    return daily.agg(
        rnd(mean(1), 4).alias("holiday_mean"), rnd(mean(0), 4).alias("normal_mean"),
        rnd((hol / F.greatest(F.lit(0.01), normal) - 1) * 100.0, 4).alias("holiday_uplift_pct"),
    )


def growth(sales: DataFrame, n: int = 5) -> DataFrame:
    """Growth of SKU units from the first to the last year; SKUs in both only."""
    years = sales.groupBy("sku_id", F.year("date").alias("y")).agg(F.sum("units_sold").alias("u"))
    span = years.agg(F.min("y").alias("a"), F.max("y").alias("b")).select(F.struct("a", "b").alias("s")).scalar()
    per = years.withColumn("_s", span).groupBy("sku_id").agg(
        F.sum(F.when(F.col("y") == F.col("_s.a"), F.col("u"))).alias("first_units"), F.sum(F.when(F.col("y") == F.col("_s.b"), F.col("u"))).alias("last_units")
    )
    g = (F.col("last_units") - F.col("first_units")) / F.greatest(F.lit(1), F.col("first_units")) * 100.0
    return per.where(F.col("first_units").isNotNull() & F.col("last_units").isNotNull()).withColumn("growth_pct", rnd(g, 4)).orderBy(F.desc("growth_pct"), "sku_id").limit(n)


def projection(sales: DataFrame, days: int = 30) -> DataFrame:
    daily = sales.groupBy("date").agg(F.sum("units_sold").alias("u"))
    return daily.agg(rnd(F.avg("u"), 4).alias("mean_daily_units"), rnd(F.avg("u") * days, 4).alias("projected_units"))


def business_answers(sales: DataFrame, calendar: DataFrame, risk: DataFrame) -> DataFrame:
    """Key figures behind the ten questions and the recommendation texts."""
    crit = F.col("stockout_risk_level") == "CRITICAL / HIGH"
    row = risk.agg(
        F.count_if("reorder_triggered").alias("reorder_count"), rnd(F.sum(F.when(F.col("reorder_triggered"), F.col("recommended_order_spend"))), 4).alias("reorder_spend"),
        F.count_if(crit).alias("critical_count"), rnd(F.coalesce(F.sum(F.when(crit, F.col("potential_lost_daily_revenue"))), F.lit(0.0)) * 30, 4).alias("lost_revenue_monthly"),
        F.count_if(F.col("overstock_risk_level") == "SEVERE OVERSTOCK").alias("severe_overstock_count"),
        rnd(F.sum("capital_tied_up"), 4).alias("capital_tied_up"), rnd(F.sum("annual_holding_cost"), 4).alias("annual_holding_cost"),
    )
    row = row.withColumns({
        "holiday_uplift_pct": holiday_uplift(sales, calendar).select("holiday_uplift_pct").scalar(),
        "projected_units_30d": projection(sales).select("projected_units").scalar(),
    })
    money = lambda c: F.format_string("%.2f", F.col(c))
    return row.withColumns({
        "reorder_text": F.concat(F.lit("Purchase review: "), F.col("reorder_count").cast("string"), F.lit(" store-SKU items at or below reorder point, spend "), money("reorder_spend")),
        "overstock_text": F.concat(F.lit("Overstock: "), money("capital_tied_up"), F.lit(" tied up, holding cost "), money("annual_holding_cost"), F.lit(" per year")),
    })


def yearly_growth(sales: DataFrame) -> DataFrame:
    years = sales.groupBy(F.year("date").alias("year")).agg(rnd(F.sum("total_revenue"), 4).alias("revenue"))
    before = F.lag("revenue").over(Window.orderBy("year"))  # one row per year
    return years.withColumn("yoy_growth_pct", rnd(ratio(F.col("revenue") - before, before) * 100.0, 4))


def by_source(facts: DataFrame) -> DataFrame:
    t = facts.groupBy("source_dataset").agg(
        rnd(F.sum("revenue"), 4).alias("revenue"), F.sum("units_sold").alias("units"), F.sum("transaction_count").alias("transactions"),
        F.count_distinct("date").alias("active_days"), F.count_distinct("product_key").alias("products"),
    )
    return t.withColumns({
        "average_order_value": rnd(ratio("revenue", "transactions"), 4), "realised_price": rnd(ratio("revenue", "units"), 4),
        "daily_revenue": rnd(ratio("revenue", "active_days"), 4), "daily_units": rnd(ratio("units", "active_days"), 4),
    })


def daily_trend(facts: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Daily revenue and units with trailing averages, the current day included.

    Averages are taken in whole 1/10000 units, so they do not depend on the order
    in which a frame is summed.
    """
    daily = facts.groupBy("source_dataset", "date").agg(rnd(F.sum("revenue"), 4).alias("revenue"), F.sum("units_sold").alias("units"))
    daily = daily.withColumn("_exact", F.rint(F.col("revenue") * 10000.0).cast("long"))
    w = Window.partitionBy("source_dataset").orderBy("date")  # one row per day

    def mean(k: int) -> Column:
        frame = w.rowsBetween(-(k - 1), 0)
        return rnd(F.sum("_exact").over(frame) / F.count("_exact").over(frame) / 10000.0, 4)

    return daily.withColumns({f"revenue_ma_{k}": mean(k) for k in windows}).drop("_exact")


def monthly(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source_dataset", F.date_format("date", "yyyy-MM").alias("month")).agg(
        rnd(F.sum("revenue"), 4).alias("revenue"), F.sum("units_sold").alias("units"), F.sum("transaction_count").alias("transactions")
    )


def product_performance(facts: DataFrame, products: DataFrame) -> DataFrame:
    t = facts.groupBy("source_dataset", "product_key").agg(F.sum("revenue").alias("r"), F.sum("units_sold").alias("units"), F.count_distinct("date").alias("active_days"))
    j = t.join(products.select("product_key", "cost_price", "category"), "product_key", "left")
    return j.select(
        "source_dataset", "product_key", "category", rnd("r", 4).alias("revenue"), "units", "active_days",
        rnd(ratio("r", "units"), 4).alias("realised_price"), rnd(ratio(F.col("r") - F.col("units") * F.col("cost_price"), "r") * 100.0, 4).alias("gross_margin_pct"),
    )


def product_revenue(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source_dataset", "product_key").agg(rnd(F.sum("revenue"), 4).alias("revenue"))


def pareto(facts: DataFrame, cut: float = 0.8) -> DataFrame:
    """Products needed for ``cut`` of revenue, per source."""
    curve = running_share(product_revenue(facts), ["source_dataset"], "revenue", "product_key")
    reach = F.col("cumulative_share") >= cut
    return curve.groupBy("source_dataset").agg(
        F.count(N).alias("products"), F.min(F.when(reach, F.col("rank"))).alias("rank_at_cut"), rnd(F.min(F.when(reach, F.col("rank_pct"))) * 100.0, 4).alias("rank_pct_at_cut"),
    )


def by_category(sales: DataFrame, skus: DataFrame) -> DataFrame:
    per = sales.groupBy("sku_id").agg(F.sum("total_revenue").alias("r"), F.sum("units_sold").alias("u"))
    j = per.join(skus.select("sku_id", "category", "cost_price"), "sku_id", "left")
    t = j.groupBy("category").agg(F.sum("r").alias("r"), F.sum("u").alias("u"), F.sum(F.col("u") * F.col("cost_price")).alias("c"))
    w = Window.partitionBy()  # one row per category
    return t.select(
        "category", rnd("r", 4).alias("revenue"), F.col("u").alias("units"), rnd(ratio("r", F.sum("r").over(w)) * 100.0, 4).alias("revenue_share_pct"),
        rnd(ratio("u", F.sum("u").over(w)) * 100.0, 4).alias("unit_share_pct"), rnd(ratio(F.col("r") - F.col("c"), "r") * 100.0, 4).alias("gross_margin_pct"),
    )


def guest_split(lines: DataFrame) -> DataFrame:
    sales = lines.where(F.col("transaction_type") == "SALE")
    t = sales.groupBy("is_guest_transaction").agg(rnd(F.sum(F.col("quantity") * F.col("price")), 4).alias("revenue"), F.count(N).alias("lines"), F.count_distinct("invoice").alias("invoices"))
    w = Window.partitionBy()  # two rows
    return t.withColumn("revenue_share_pct", rnd(ratio("revenue", F.sum("revenue").over(w)) * 100.0, 4))


def customer_value(customers: DataFrame) -> DataFrame:
    """Spend per identified customer: mean, median and maximum."""
    rows = customers.where(F.col("source_dataset") == "UCI")
    t = rows.groupBy("source_dataset").agg(
        F.count(N).alias("customers"), rnd(F.avg("total_revenue"), 4).alias("mean_revenue"), rnd(F.max("total_revenue"), 4).alias("max_revenue"), rnd(F.avg("transaction_count"), 4).alias("mean_transactions")
    )
    m = exact_quantiles(rows, "total_revenue", [0.5], ["source_dataset"], ["m"])
    return t.join(m.select("source_dataset", rnd("m", 4).alias("median_revenue")), "source_dataset")


def segments(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_segment", "loyalty_member").agg(F.count(N).alias("customers"))


def by_country(lines: DataFrame) -> DataFrame:
    sales = lines.where(F.col("transaction_type") == "SALE")
    t = sales.groupBy("country").agg(F.sum(F.col("quantity") * F.col("price")).alias("r"), F.sum("quantity").cast("long").alias("units"), F.count_distinct("customer_id").alias("customers"))
    w = Window.partitionBy()  # one row per country
    return t.select("country", rnd("r", 4).alias("revenue"), "units", "customers", rnd(ratio("r", F.sum("r").over(w)) * 100.0, 4).alias("revenue_share_pct"))


def store_ranking(sales: DataFrame, stores: DataFrame) -> DataFrame:
    t = sales.groupBy("store_id").agg(rnd(F.sum("total_revenue"), 4).alias("revenue"), F.sum("units_sold").alias("units"))
    j = t.join(stores.select("store_id", "store_type", "store_size_sqft"), "store_id", "left")
    return j.withColumn("revenue_per_sqft", rnd(ratio("revenue", "store_size_sqft"), 4))


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """Global row rank without a one-task sort (see ``running_share``)."""
    out = running_share(df.withColumn("_all", F.lit("all")), ["_all"], value, key)
    return out.drop("_all", "share_before", "rank_pct", "cumulative_share")


def size_correlation(ranking: DataFrame) -> DataFrame:
    return ranking.agg(F.count(N).alias("stores"), rnd(F.corr("store_size_sqft", "revenue"), 6).alias("size_revenue_corr"))


def profile_by(facts: DataFrame, name: str, part: Column) -> DataFrame:
    return facts.groupBy("source_dataset", part.alias(name)).agg(rnd(F.avg("units_sold"), 4).alias("mean_units"), rnd(F.sum("revenue"), 4).alias("revenue"), F.count(N).alias("rows"))


def weekday_variation(facts: DataFrame) -> DataFrame:
    means = facts.groupBy("source_dataset", F.weekday("date").alias("dow")).agg(F.avg("units_sold").alias("m"))
    return means.groupBy("source_dataset").agg(rnd(F.coalesce(ratio(F.stddev_samp("m"), F.avg("m")), F.lit(0.0)), 4).alias("dow_cv"))


def weekday_month_heatmap(sales: DataFrame) -> DataFrame:
    months = list(range(1, 13))
    table = sales.withColumn("_m", F.month("date")).groupBy(F.weekday("date").alias("dow")).pivot("_m", months).agg(F.avg("units_sold"))
    return table.select("dow", *[rnd(F.coalesce(F.col(str(m)), F.lit(0.0)), 4).alias(f"m{m}") for m in months])


def promotion_impact(sales: DataFrame) -> DataFrame:
    return sales.groupBy("promotion_flag").agg(
        F.count(N).alias("records"), rnd(F.avg("units_sold"), 4).alias("mean_units"), rnd(F.avg("total_revenue"), 4).alias("mean_revenue"),
        rnd(F.avg("avg_unit_price"), 4).alias("mean_price"),
    )


def price_demand(sales: DataFrame, cap: float = 0.99) -> DataFrame:
    """Correlation of price and units: plain, log-log and with capped units."""
    rows = sales.where((F.col("avg_unit_price") > 0) & (F.col("units_sold") > 0)).withColumn("_all", F.lit("all"))
    top = exact_quantiles(rows, "units_sold", [cap], ["_all"], ["q"]).select("q").scalar()
    rows = rows.withColumn("_cap", F.least(F.col("units_sold").cast("double"), top))
    return rows.agg(
        F.count(N).alias("n"), rnd(F.corr("avg_unit_price", "units_sold"), 6).alias("price_units_corr"),
        rnd(F.corr(F.log("avg_unit_price"), F.log("units_sold")), 6).alias("loglog_corr"), rnd(F.corr("avg_unit_price", "_cap"), 6).alias("capped_corr"),
        rnd(F.max("_cap"), 4).alias("units_cap"),
    )


def inventory_trajectory(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("date").agg(
        F.sum("ending_inventory").alias("ending_inventory"), F.sum("units_sold").alias("units_sold"), F.sum("on_order_qty").alias("on_order"),
        rnd(F.avg("stockout_flag") * 100.0, 4).alias("stockout_rate_pct"), rnd(ratio(F.sum("ending_inventory"), F.sum("units_sold")), 4).alias("doi"),
    )


def stockout_rate(inventory: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    return inventory.groupBy(*by).agg(F.count(N).alias("snapshots"), F.sum("stockout_flag").alias("stockouts"), rnd(F.avg("stockout_flag") * 100.0, 4).alias("stockout_rate_pct"))


def slow_stock(inventory: DataFrame, sales: DataFrame, skus: DataFrame, days: int = 30, limit_days: float = 60.0) -> DataFrame:
    """Latest stock covering more than ``limit_days`` of trailing demand, and its cost."""
    start = sales.agg(F.date_sub(F.max("date"), days).alias("m")).select("m").scalar()
    rate = sales.where(F.col("date") >= start).groupBy("store_id", "sku_id").agg((F.sum("units_sold") / float(days)).alias("daily"))
    j = latest(inventory, "date").join(rate, ["store_id", "sku_id"], "left").join(skus.select("sku_id", "cost_price"), "sku_id", "left")
    dos = ratio("ending_inventory", "daily")
    slow = j.withColumn("_dos", dos).where(F.col("_dos") > limit_days)
    return slow.groupBy("sku_id").agg(
        F.count(N).alias("stores"), F.sum("ending_inventory").alias("units"), rnd(F.sum(F.col("ending_inventory") * F.col("cost_price")), 4).alias("trapped_capital"),
        rnd(F.max("_dos"), 4).alias("max_days_of_supply"),
    )


def return_rate_by_month(sales: DataFrame, returns: DataFrame) -> DataFrame:
    m = F.date_format("date", "yyyy-MM").alias("month")
    sold = sales.where(F.col("source_dataset") == "UCI").groupBy(m).agg(F.sum("units_sold").alias("units_sold"))
    back = returns.groupBy(m).agg(F.sum("quantity_returned").cast("long").alias("returned"))
    return sold.join(back, "month", "left").select(
        "month", "units_sold", F.coalesce("returned", F.lit(0)).alias("returned"), rnd(F.coalesce(ratio("returned", "units_sold"), F.lit(0.0)) * 100.0, 4).alias("return_rate_pct")
    )


def top_products(facts: DataFrame, quantity: str, n: int) -> DataFrame:
    t = facts.groupBy("product_key").agg(F.sum(quantity).cast("long").alias("quantity"), rnd(F.sum("revenue_impact"), 4).alias("revenue_impact"))
    return t.orderBy(F.desc("quantity"), "product_key").limit(n)


METRIC_PAIRS = (("revenue", "units"), ("revenue", "transactions"), ("units", "transactions"), ("units", "price"), ("revenue", "price"), ("transactions", "price"))


def correlation_matrix(facts: DataFrame) -> DataFrame:
    daily = facts.groupBy("source_dataset", "date").agg(
        F.sum("revenue").alias("revenue"), F.sum("units_sold").cast("double").alias("units"), F.sum("transaction_count").cast("double").alias("transactions"),
        F.avg("average_unit_price").alias("price"),
    )
    return daily.groupBy("source_dataset").agg(*[rnd(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in METRIC_PAIRS])


def box_stats(facts: DataFrame, value: str, cap: float = 0.99) -> DataFrame:
    names = ["p25", "p50", "p75", "cap"]
    q = exact_quantiles(facts, value, [0.25, 0.5, 0.75, cap], ["source_dataset"], names)
    ends = facts.groupBy("source_dataset").agg(F.min(value).cast("double").alias("min_value"), F.max(value).cast("double").alias("max_value"))
    return ends.join(q, "source_dataset").select("source_dataset", "n", "min_value", *[rnd(c, 4).alias(c) for c in names], "max_value")


def weekly_totals(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("source_dataset", "week").agg(F.sum("units_sold").alias("units_sold"), F.count(N).alias("skus"))


def demand_by_calendar(weekly: DataFrame, weekly_calendar: DataFrame) -> DataFrame:
    per = weekly.groupBy("source_dataset", "week").agg(F.sum("units_sold").alias("u"), F.count(N).alias("k"))
    j = per.join(weekly_calendar.select("week", "season", "is_holiday_week"), "week", "left")
    return j.groupBy("source_dataset", "season", "is_holiday_week").agg(rnd(ratio(F.sum("u"), F.sum("k")), 4).alias("mean_demand"), F.sum("k").alias("rows"))
