"""Business KPI queries."""

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.operators import kpi
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, ci, div, pct, r

REV = r("sum(total_revenue)", 4)


@query("k1_executive_kpis", f"""
WITH l AS (SELECT i.*, cost_price, safety_stock, reorder_point FROM inventory_snapshots i LEFT JOIN sku_master k ON i.sku_id = k.sku_id WHERE date = (SELECT max(date) FROM inventory_snapshots))
SELECT {big('sum(ending_inventory)')} AS total_inventory_units, {r('sum(ending_inventory * cost_price)', 4)} AS total_inventory_value, {big('sum(stockout_flag)')} AS current_stockout_count,
 {r('avg(stockout_flag) * 100', 4)} AS current_stockout_rate_pct, {ci('ending_inventory <= reorder_point')} AS reorder_triggered_count, {ci('ending_inventory < safety_stock')} AS safety_stock_breaches,
 max(date) AS latest_date, (SELECT count(*) FROM store_master) AS total_stores, (SELECT count(*) FROM sku_master) AS total_skus, (SELECT {REV} FROM sales_daily) AS total_revenue,
 (SELECT {big('sum(units_sold)')} FROM sales_daily) AS total_units_sold, (SELECT {big('sum(transaction_count)')} FROM sales_daily) AS total_transactions,
 (SELECT count(DISTINCT sku_id) FROM sales_daily) AS active_skus FROM l""")
def k1(t):
    return kpi.executive(t.sales_daily, t.inventory_snapshots, t.sku_master, t.store_master)


def _ranked(order):
    return f"""
SELECT s.*, sku_name, category, brand, {r(f"{div('base_price - cost_price', 'base_price')} * 100", 4)} AS margin_pct FROM (
 SELECT sku_id, {big('sum(units_sold)')} AS total_units, {REV} AS total_revenue, {r('avg(avg_unit_price)', 4)} AS avg_price, count(DISTINCT date) AS active_days
 FROM sales_daily GROUP BY 1 ORDER BY {REV} {order}, sku_id LIMIT 10) s LEFT JOIN sku_master k ON s.sku_id = k.sku_id"""


@query("k2_top_skus", _ranked("DESC"))
def k2a(t):
    return kpi.ranked_skus(t.sales_daily, t.sku_master, 10, best=True)


@query("k2_bottom_skus", _ranked("ASC"))
def k2b(t):
    return kpi.ranked_skus(t.sales_daily, t.sku_master, 10, best=False)


@query("k3_store_type_region", f"""
SELECT store_type, region, {REV} AS total_revenue, {big('sum(units_sold)')} AS total_units, {r('avg(avg_unit_price)', 4)} AS avg_price, count(DISTINCT s.store_id) AS stores
FROM sales_daily s LEFT JOIN store_master m ON s.store_id = m.store_id GROUP BY 1, 2""")
def k3(t):
    return kpi.by_store_attributes(t.sales_daily, t.store_master, ["store_type", "region"])


@query("k4_monthly_seasonality", f"SELECT month(date) AS month, {REV} AS total_revenue, {big('sum(units_sold)')} AS total_units FROM sales_daily GROUP BY 1")
def k4a(t):
    return kpi.monthly_seasonality(t.daily_units)


UPLIFT = f"""SELECT {r('h', 4)} AS holiday_mean, {r('n', 4)} AS normal_mean, {r('(COALESCE(h, 0) / greatest(0.01, COALESCE(n, 1)) - 1) * 100', 4)} AS holiday_uplift_pct FROM (
 SELECT avg(CASE WHEN is_holiday = 1 THEN units_sold END) AS h, avg(CASE WHEN is_holiday = 0 THEN units_sold END) AS n FROM sales_daily s LEFT JOIN calendar c ON s.date = c.date) t"""


@query("k4_holiday_uplift", UPLIFT)
def k4b(t):
    return kpi.holiday_uplift(t.daily_units, t.calendar)


@query("k5_sku_growth", f"""
SELECT sku_id, first_units, last_units, {r('(last_units - first_units) / CAST(greatest(1, first_units) AS DOUBLE) * 100', 4)} AS growth_pct FROM (
 SELECT sku_id, {big('sum(CASE WHEN year(date) = lo THEN units_sold END)')} AS first_units, {big('sum(CASE WHEN year(date) = hi THEN units_sold END)')} AS last_units
 FROM sales_daily, (SELECT min(year(date)) AS lo, max(year(date)) AS hi FROM sales_daily) y GROUP BY 1) t
WHERE first_units IS NOT NULL AND last_units IS NOT NULL ORDER BY growth_pct DESC, sku_id LIMIT 5""")
def k5(t):
    return kpi.growth(t.daily_units)


@query("k6_projection_30d", f"SELECT {r('avg(u)', 4)} AS mean_daily_units, {r('avg(u) * 30', 4)} AS projected_units FROM (SELECT date, sum(units_sold) AS u FROM sales_daily GROUP BY 1) t")
def k6(t):
    return kpi.projection(t.daily_units)


@query("k7_business_answers", f"""
WITH a AS (SELECT {ci('reorder_triggered')} AS reorder_count, {r('sum(CASE WHEN reorder_triggered THEN recommended_order_spend END)', 4)} AS reorder_spend,
 {ci("stockout_risk_level = 'CRITICAL / HIGH'")} AS critical_count, {r("COALESCE(sum(CASE WHEN stockout_risk_level = 'CRITICAL / HIGH' THEN potential_lost_daily_revenue END), 0) * 30", 4)} AS lost_revenue_monthly,
 {ci("overstock_risk_level = 'SEVERE OVERSTOCK'")} AS severe_overstock_count, {r('sum(capital_tied_up)', 4)} AS capital_tied_up, {r('sum(annual_holding_cost)', 4)} AS annual_holding_cost FROM risk_matrix)
SELECT *, (SELECT holiday_uplift_pct FROM ({UPLIFT}) u) AS holiday_uplift_pct, (SELECT {r('avg(u) * 30', 4)} FROM (SELECT sum(units_sold) AS u FROM sales_daily GROUP BY date) p) AS projected_units_30d,
 concat('Purchase review: ', CAST(reorder_count AS VARCHAR), ' store-SKU items at or below reorder point, spend ', printf('%.2f', reorder_spend)) AS reorder_text,
 concat('Overstock: ', printf('%.2f', capital_tied_up), ' tied up, holding cost ', printf('%.2f', annual_holding_cost), ' per year') AS overstock_text FROM a""")
def k7(t):
    return kpi.business_answers(t.daily_units, t.calendar, t.risk_matrix)


@query("k8_yearly_growth", f"""
SELECT year, revenue, {r(f"{div('revenue - lag(revenue) OVER (ORDER BY year)', 'lag(revenue) OVER (ORDER BY year)')} * 100", 4)} AS yoy_growth_pct
FROM (SELECT year(date) AS year, {REV} AS revenue FROM sales_daily GROUP BY 1) t""")
def k8(t):
    return kpi.yearly_growth(t.daily_units)


@query("k9_source_totals", f"""
SELECT *, {r(div('revenue', 'transactions'), 4)} AS average_order_value, {r(div('revenue', 'units'), 4)} AS realised_price, {r(div('revenue', 'active_days'), 4)} AS daily_revenue, {r(div('units', 'active_days'), 4)} AS daily_units
FROM (SELECT source_dataset, {r('sum(revenue)', 4)} AS revenue, {big('sum(units_sold)')} AS units, {big('sum(transaction_count)')} AS transactions, count(DISTINCT date) AS active_days, count(DISTINCT product_key) AS products
 FROM fact_sales GROUP BY 1) t""")
def k9(t):
    return kpi.by_source(t.fact_sales)


def _ma(k):
    frame = f"OVER (PARTITION BY source_dataset ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return r(f"CAST(sum(x) {frame} AS DOUBLE) / count(x) {frame} / CAST(10000 AS DOUBLE)", 4)


@query("k10_daily_trend", f"""
SELECT source_dataset, date, revenue, units, {_ma(7)} AS revenue_ma_7, {_ma(30)} AS revenue_ma_30 FROM (
 SELECT *, CAST(round_even(revenue * CAST(10000 AS DOUBLE), 0) AS BIGINT) AS x FROM (SELECT source_dataset, date, {r('sum(revenue)', 4)} AS revenue, {big('sum(units_sold)')} AS units FROM fact_sales GROUP BY 1, 2) t) u""")
def k10(t):
    return kpi.daily_trend(t.fact_sales)


@query("k11_monthly", f"""
SELECT source_dataset, strftime(date, '%Y-%m') AS month, {r('sum(revenue)', 4)} AS revenue, {big('sum(units_sold)')} AS units, {big('sum(transaction_count)')} AS transactions FROM fact_sales GROUP BY 1, 2""")
def k11(t):
    return kpi.monthly(t.fact_sales)


@query("k12_product_performance", f"""
SELECT f.source_dataset, f.product_key, category, {r('rev', 4)} AS revenue, units, active_days, {r(div('rev', 'units'), 4)} AS realised_price, {r(f"{div('rev - units * cost_price', 'rev')} * 100", 4)} AS gross_margin_pct
FROM (SELECT source_dataset, product_key, sum(revenue) AS rev, {big('sum(units_sold)')} AS units, count(DISTINCT date) AS active_days FROM fact_sales GROUP BY 1, 2) f
LEFT JOIN dim_product p ON f.product_key = p.product_key""")
def k12(t):
    return kpi.product_performance(t.fact_sales, t.dim_product)


CURVE = f"""SELECT source_dataset, product_key, revenue, row_number() OVER w AS rank, sum(revenue) OVER w / sum(revenue) OVER (PARTITION BY source_dataset) AS share,
 count(*) OVER (PARTITION BY source_dataset) AS size FROM (SELECT source_dataset, product_key, {r('sum(revenue)', 4)} AS revenue FROM fact_sales GROUP BY 1, 2) t
 WINDOW w AS (PARTITION BY source_dataset ORDER BY revenue DESC, product_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("k13_pareto", f"""
SELECT source_dataset, count(*) AS products, min(CASE WHEN share >= 0.8 THEN rank END) AS rank_at_cut, {r('min(CASE WHEN share >= 0.8 THEN rank / CAST(size AS DOUBLE) END) * 100', 4)} AS rank_pct_at_cut FROM ({CURVE}) c GROUP BY 1""")
def k13(t):
    return kpi.pareto(t.fact_sales)


@query("k14_category", f"""
SELECT category, {r('rev', 4)} AS revenue, units, {r('rev / sum(rev) OVER () * 100', 4)} AS revenue_share_pct, {r('units / sum(units) OVER () * 100', 4)} AS unit_share_pct, {r(f"{div('rev - c', 'rev')} * 100", 4)} AS gross_margin_pct
FROM (SELECT category, sum(total_revenue) AS rev, {big('sum(units_sold)')} AS units, sum(units_sold * cost_price) AS c FROM sales_daily s LEFT JOIN sku_master k ON s.sku_id = k.sku_id GROUP BY 1) t""")
def k14(t):
    return kpi.by_category(t.daily_units, t.sku_master)


@query("k15_guest_split", f"""
SELECT *, {r('revenue / sum(revenue) OVER () * 100', 4)} AS revenue_share_pct FROM (SELECT is_guest_transaction, {r('sum(quantity * price)', 4)} AS revenue, count(*) AS lines, count(DISTINCT invoice) AS invoices
 FROM clean_lines WHERE transaction_type = 'SALE' GROUP BY 1) t""")
def k15a(t):
    return kpi.guest_split(t.clean_lines)


@query("k15_customer_value", f"""
SELECT 'UCI' AS source_dataset, count(*) AS customers, {r('avg(v)', 4)} AS mean_revenue, {r('max(v)', 4)} AS max_revenue, {r('avg(transaction_count)', 4)} AS mean_transactions, {r('quantile_cont(v, 0.5)', 4)} AS median_revenue
FROM (SELECT {r('total_revenue', 4)} AS v, transaction_count FROM customer_analytics WHERE source_dataset = 'UCI') t""")
def k15b(t):
    return kpi.customer_value(t.customer_analytics.withColumn("total_revenue", rnd("total_revenue", 4)))


@query("k15_segments", "SELECT customer_segment, loyalty_member, count(*) AS customers FROM customer_master GROUP BY 1, 2")
def k15c(t):
    return kpi.segments(t.customer_master)


@query("k16_country", f"""
SELECT country, {r('rev', 4)} AS revenue, units, customers, {r('rev / sum(rev) OVER () * 100', 4)} AS revenue_share_pct FROM (SELECT country, sum(quantity * price) AS rev, {big('sum(quantity)')} AS units,
 count(DISTINCT customer_id) AS customers FROM clean_lines WHERE transaction_type = 'SALE' GROUP BY 1) t""")
def k16a(t):
    return kpi.by_country(t.clean_lines)


@query("k16_region", f"""
SELECT region, city, {REV} AS total_revenue, {big('sum(units_sold)')} AS total_units, {r('avg(avg_unit_price)', 4)} AS avg_price, count(DISTINCT s.store_id) AS stores
FROM sales_daily s LEFT JOIN store_master m ON s.store_id = m.store_id GROUP BY 1, 2""")
def k16b(t):
    return kpi.by_store_attributes(t.sales_daily, t.store_master, ["region", "city"])


STORES = f"""SELECT s.store_id, revenue, units, store_type, store_size_sqft, {r(div('revenue', 'store_size_sqft'), 4)} AS revenue_per_sqft FROM (
 SELECT store_id, {REV} AS revenue, {big('sum(units_sold)')} AS units FROM sales_daily GROUP BY 1) s LEFT JOIN store_master m ON s.store_id = m.store_id"""


@query("k17_store_ranking", f"SELECT *, row_number() OVER (ORDER BY revenue DESC, store_id) AS rank FROM ({STORES}) t")
def k17a(t):
    return kpi.ranked(kpi.store_ranking(t.daily_units, t.store_master), "revenue", "store_id")


@query("k17_size_correlation", f"SELECT count(*) AS stores, {r('corr(store_size_sqft, revenue)', 6)} AS size_revenue_corr FROM ({STORES}) t")
def k17b(t):
    return kpi.size_correlation(kpi.store_ranking(t.daily_units, t.store_master))


def _profile(name, part):
    return f"SELECT source_dataset, {part} AS {name}, {r('avg(units_sold)', 4)} AS mean_units, {r('sum(revenue)', 4)} AS revenue, count(*) AS rows FROM fact_sales GROUP BY 1, 2"


@query("k18_weekday_profile", _profile("dow", "CAST(isodow(date) - 1 AS INTEGER)"))
def k18a(t):
    return kpi.profile_by(t.fact_sales, "dow", F.weekday("date"))


@query("k18_month_profile", _profile("month", "CAST(month(date) AS INTEGER)"))
def k18b(t):
    return kpi.profile_by(t.fact_sales, "month", F.month("date"))


@query("k18_weekday_variation", f"""
SELECT source_dataset, {r('COALESCE(stddev_samp(m) / avg(m), 0)', 4)} AS dow_cv FROM (SELECT source_dataset, isodow(date) AS d, avg(units_sold) AS m FROM fact_sales GROUP BY 1, 2) t GROUP BY 1""")
def k18c(t):
    return kpi.weekday_variation(t.fact_sales)


@query("k18_heatmap", f"""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, {', '.join(r(f'COALESCE(avg(CASE WHEN month(date) = {m} THEN units_sold END), 0)', 4) + f' AS m{m}' for m in range(1, 13))} FROM sales_daily GROUP BY 1""")
def k18d(t):
    return kpi.weekday_month_heatmap(t.daily_units)


@query("k19_promotion_impact", f"""
SELECT promotion_flag, count(*) AS records, {r('avg(units_sold)', 4)} AS mean_units, {r('avg(total_revenue)', 4)} AS mean_revenue, {r('avg(avg_unit_price)', 4)} AS mean_price FROM sales_daily GROUP BY 1""")
def k19(t):
    return kpi.promotion_impact(t.sales_daily)


@query("k20_price_demand", f"""
SELECT count(*) AS n, {r('corr(avg_unit_price, units_sold)', 6)} AS price_units_corr, {r('corr(ln(avg_unit_price), ln(units_sold))', 6)} AS loglog_corr, {r('corr(avg_unit_price, least(units_sold, cap))', 6)} AS capped_corr,
 {r('max(least(units_sold, cap))', 4)} AS units_cap FROM sales_daily, (SELECT quantile_cont(CAST(units_sold AS DOUBLE), 0.99) AS cap FROM sales_daily) c WHERE avg_unit_price > 0 AND units_sold > 0""")
def k20(t):
    return kpi.price_demand(t.sales_daily)


@query("k21_inventory_trajectory", f"""
SELECT date, {big('sum(ending_inventory)')} AS ending_inventory, {big('sum(units_sold)')} AS units_sold, {big('sum(on_order_qty)')} AS on_order, {r('avg(stockout_flag) * 100', 4)} AS stockout_rate_pct,
 {r(div('sum(ending_inventory)', 'sum(units_sold)'), 4)} AS doi FROM inventory_snapshots GROUP BY 1""")
def k21(t):
    return kpi.inventory_trajectory(t.inventory_snapshots)


def _stockout(sel, by):
    return f"SELECT {sel}, count(*) AS snapshots, {big('sum(stockout_flag)')} AS stockouts, {r('avg(stockout_flag) * 100', 4)} AS stockout_rate_pct FROM inventory_snapshots GROUP BY {by}"


@query("k22_stockout_by_sku_store", _stockout("sku_id, store_id", "1, 2"))
def k22a(t):
    return kpi.stockout_rate(t.inventory_snapshots, ["sku_id", "store_id"])


@query("k22_stockout_by_month", _stockout("strftime(date, '%Y-%m') AS month", "1"))
def k22b(t):
    return kpi.stockout_rate(t.inventory_snapshots, [F.date_format("date", "yyyy-MM").alias("month")])


@query("k23_slow_stock", f"""
SELECT i.sku_id, count(*) AS stores, {big('sum(ending_inventory)')} AS units, {r('sum(ending_inventory * cost_price)', 4)} AS trapped_capital, {r('max(ending_inventory / NULLIF(daily, 0))', 4)} AS max_days_of_supply
FROM inventory_snapshots i LEFT JOIN (SELECT store_id, sku_id, sum(units_sold) / CAST(30 AS DOUBLE) AS daily FROM sales_daily WHERE date >= (SELECT max(date) - 30 FROM sales_daily) GROUP BY 1, 2) d
 ON i.store_id = d.store_id AND i.sku_id = d.sku_id LEFT JOIN sku_master k ON i.sku_id = k.sku_id
WHERE date = (SELECT max(date) FROM inventory_snapshots) AND ending_inventory / NULLIF(daily, 0) > 60 GROUP BY 1""")
def k23(t):
    return kpi.slow_stock(t.inventory_snapshots, t.daily_units, t.sku_master)


def _top(table, qty):
    return f"""SELECT product_key, {big(f'sum({qty})')} AS quantity, {r('sum(revenue_impact)', 4)} AS revenue_impact FROM {table} GROUP BY 1 ORDER BY quantity DESC, product_key LIMIT 20"""


@query("k24_top_returns", _top("fact_returns", "quantity_returned"))
def k24a(t):
    return kpi.top_products(t.fact_returns, "quantity_returned", 20)


@query("k24_top_cancellations", _top("fact_cancellations", "cancelled_quantity"))
def k24b(t):
    return kpi.top_products(t.fact_cancellations, "cancelled_quantity", 20)


@query("k24_return_rate", f"""
SELECT s.month, units_sold, {big('COALESCE(returned, 0)')} AS returned, {r('COALESCE(CAST(returned AS DOUBLE) / NULLIF(units_sold, 0), 0) * 100', 4)} AS return_rate_pct
FROM (SELECT strftime(date, '%Y-%m') AS month, {big('sum(units_sold)')} AS units_sold FROM online_sales GROUP BY 1) s
LEFT JOIN (SELECT strftime(date, '%Y-%m') AS month, sum(quantity_returned) AS returned FROM fact_returns GROUP BY 1) b ON s.month = b.month""")
def k24c(t):
    return kpi.return_rate_by_month(t.fact_sales, t.fact_returns)


@query("k25_correlation_matrix", f"""
SELECT source_dataset, {', '.join(f"{r(f'corr({a}, {b})', 6)} AS {a}_{b}" for a, b in kpi.METRIC_PAIRS)} FROM (SELECT source_dataset, date, sum(revenue) AS revenue, CAST(sum(units_sold) AS DOUBLE) AS units,
 CAST(sum(transaction_count) AS DOUBLE) AS transactions, avg(average_unit_price) AS price FROM fact_sales GROUP BY 1, 2) t GROUP BY 1""")
def k25(t):
    return kpi.correlation_matrix(t.fact_sales)


@query("k26_box_statistics", f"""
SELECT source_dataset, count(*) AS n, CAST(min(units_sold) AS DOUBLE) AS min_value, {', '.join(f"{r(f'quantile_cont(CAST(units_sold AS DOUBLE), {p})', 4)} AS {n}" for n, p in (('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('cap', 0.99)))},
 CAST(max(units_sold) AS DOUBLE) AS max_value FROM fact_sales GROUP BY 1""")
def k26(t):
    return kpi.box_stats(t.fact_sales, "units_sold")


@query("k27_weekly_totals", f"SELECT source_dataset, week, {big('sum(units_sold)')} AS units_sold, count(*) AS skus FROM weekly_demand GROUP BY 1, 2")
def k27a(t):
    return kpi.weekly_totals(t.weekly_demand)


@query("k27_top_weekly_skus", f"SELECT product_key, {big('sum(units_sold)')} AS units_sold FROM weekly_demand GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def k27b(t):
    return t.weekly_demand.groupBy("product_key").agg(F.sum("units_sold").alias("units_sold")).orderBy(F.desc("units_sold"), "product_key").limit(20)


@query("k27_demand_by_season", f"""
SELECT source_dataset, season, is_holiday_week, {r('avg(units_sold)', 4)} AS mean_demand, count(*) AS rows FROM weekly_demand d LEFT JOIN weekly_calendar c ON d.week = c.week GROUP BY 1, 2, 3""")
def k27c(t):
    return kpi.demand_by_calendar(t.weekly_demand, t.weekly_calendar)
