"""Cleaning and star-schema queries."""

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.operators import cleaning, quality, star
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, ci, r, week

LINE = """invoice, stock_code, description, quantity, CAST(invoice_date AS DATE) AS day, price, customer_id, country, description_recovered,
 description_source, transaction_type, invoice_year, invoice_month, invoice_weekday, is_guest_transaction, price_category, is_special_transaction"""


def _line(df):
    return df.withColumn("day", F.col("invoice_date").cast("date")).drop("invoice_date", "invoice_date_only")


@query("c1_transaction_type", """
SELECT transaction_type, price < 0 AS negative_price, quantity < 0 AS negative_quantity, count(*) AS n, sum(quantity) AS quantity
FROM (SELECT CASE WHEN invoice LIKE 'C%' THEN 'CANCELLATION' WHEN invoice LIKE 'A%' THEN 'INVALID' WHEN quantity < 0 THEN 'RETURN'
      WHEN price < 0 THEN 'INVALID' ELSE 'SALE' END AS transaction_type, price, quantity FROM retail_log) t GROUP BY 1, 2, 3""")
def c1(t):
    typed = t.retail_log.withColumn("transaction_type", cleaning.transaction_type())
    return typed.groupBy("transaction_type", (F.col("price") < 0).alias("negative_price"), (F.col("quantity") < 0).alias("negative_quantity")).agg(
        F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("c2_description_recovery", """
SELECT t.stock_code, COALESCE(d, modal, 'Unknown Product') AS description, d IS NULL AND modal IS NOT NULL AS description_recovered, count(*) AS n
FROM (SELECT stock_code, NULLIF(trim(description), '') AS d FROM retail_log) t LEFT JOIN modal_text m ON t.stock_code = m.stock_code GROUP BY 1, 2, 3""")
def c2(t):
    return cleaning.recover_descriptions(t.retail_log).groupBy("stock_code", "description", "description_recovered").agg(F.count("*").alias("n"))


@query("c3_clean_transactions", f"SELECT {LINE} FROM clean_lines")
def c3(t):
    return _line(t.clean_lines)


@query("c4_split_by_type", """
SELECT transaction_type, count(*) AS lines, count(DISTINCT invoice) AS invoices, sum(quantity) AS quantity, CAST(count_if(is_guest_transaction) AS BIGINT) AS guests
FROM clean_lines GROUP BY 1""")
def c4(t):
    parts = [cleaning.split(t.clean_lines, k) for k in ("SALE", "RETURN", "CANCELLATION", "INVALID")]
    return quality.union([
        p.groupBy("transaction_type").agg(
            F.count("*").alias("lines"), F.count_distinct("invoice").alias("invoices"), F.sum("quantity").alias("quantity"),
            F.count_if("is_guest_transaction").alias("guests")) for p in parts])


@query("c5_weekly_sale_lines", """
SELECT DISTINCT invoice, stock_code, description, quantity, CAST(invoice_date AS DATE) AS day, price, customer_id, country FROM retail_log
WHERE invoice NOT LIKE 'C%' AND quantity > 0 AND price > 0 AND invoice_date IS NOT NULL""")
def c5(t):
    return cleaning.sale_lines(t.retail_log).withColumn("day", F.col("invoice_date").cast("date")).drop("invoice_date")


@query("c6_inventory_pre_receipts", f"""
SELECT entity_id AS store_id, sku_id, inventory_balance_ok, count(*) AS n, {big('sum(beginning_inventory_pre_receipts)')} AS pre_receipts, min(beginning_inventory_pre_receipts) AS lowest
FROM fact_inventory GROUP BY 1, 2, 3""")
def c6(t):
    balanced = cleaning.inventory_balance(t.inventory_snapshots)
    return balanced.groupBy("store_id", "sku_id", "inventory_balance_ok").agg(
        F.count("*").alias("n"), F.sum("beginning_inventory_pre_receipts").alias("pre_receipts"), F.min("beginning_inventory_pre_receipts").alias("lowest"))


@query("d1_dim_calendar", "SELECT * FROM dim_calendar")
def d1(t):
    return t.dim_calendar


@query("d2_dim_product", f"SELECT * REPLACE ({r('cost_price', 6)} AS cost_price) FROM dim_product")
def d2(t):
    return t.dim_product.withColumn("cost_price", rnd("cost_price", 6))


@query("d3_dim_entity", "SELECT * FROM dim_entity")
def d3(t):
    return t.dim_entity


@query("d4_dim_customer", "SELECT * FROM dim_customer")
def d4(t):
    return t.dim_customer


SALES_ROUND = f"{r('revenue', 4)} AS revenue, {r('average_unit_price', 6)} AS average_unit_price"


def _sales(df):
    return df.withColumns({"revenue": rnd("revenue", 4), "average_unit_price": rnd("average_unit_price", 6)})


@query("d5_fact_sales", f"SELECT * REPLACE ({SALES_ROUND}) FROM fact_sales")
def d5(t):
    return _sales(t.fact_sales)


STOCK = ("beginning_inventory", "beginning_inventory_pre_receipts", "receipts", "units_sold", "ending_inventory", "stockout_flag", "on_order_qty")


@query("d6_fact_inventory", f"""
SELECT source_dataset, entity_id, product_key, sku_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, {ci('inventory_balance_ok')} AS balanced,
 {', '.join(f'{big(f"sum({c})")} AS {c}' for c in STOCK)} FROM fact_inventory GROUP BY 1, 2, 3, 4""")
def d6(t):
    """Whole fact, totalled per series to keep the result small."""
    return t.fact_inventory.groupBy("source_dataset", "entity_id", "product_key", "sku_id").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if("inventory_balance_ok").alias("balanced"),
        *[F.sum(c).alias(c) for c in STOCK])


@query("d7_fact_returns", f"SELECT * REPLACE ({r('revenue_impact', 4)} AS revenue_impact) FROM fact_returns")
def d7(t):
    return t.fact_returns.withColumn("revenue_impact", rnd("revenue_impact", 4))


@query("d8_fact_cancellations", f"SELECT * REPLACE ({r('revenue_impact', 4)} AS revenue_impact) FROM fact_cancellations")
def d8(t):
    return t.fact_cancellations.withColumn("revenue_impact", rnd("revenue_impact", 4))


@query("d9_customer_analytics", f"SELECT * REPLACE ({r('total_revenue', 4)} AS total_revenue) FROM customer_analytics")
def d9(t):
    return t.customer_analytics.withColumn("total_revenue", rnd("total_revenue", 4))


@query("d10_inventory_analytics", f"""
SELECT entity_id, product_key, category, sub_category, brand, lead_time_days, reorder_point, safety_stock, count(*) AS n, {big('sum(ending_inventory)')} AS ending_inventory,
 {big('sum(on_order_qty)')} AS on_order_qty, {big('sum(stockout_flag)')} AS stockouts FROM inventory_analytics GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def d10(t):
    by = ["entity_id", "product_key", "category", "sub_category", "brand", "lead_time_days", "reorder_point", "safety_stock"]
    return t.inventory_analytics.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("ending_inventory").alias("ending_inventory"), F.sum("on_order_qty").alias("on_order_qty"), F.sum("stockout_flag").alias("stockouts"))


@query("d11_forecast_base", f"SELECT * REPLACE ({SALES_ROUND}) FROM forecast_base")
def d11(t):
    return _sales(t.forecast_base)


@query("d12_wide_model", f"""
SELECT s.date, s.store_id, s.sku_id, s.units_sold, {r('s.total_revenue', 4)} AS total_revenue, i.ending_inventory, i.units_sold AS units_sold_inv, k.category, m.region,
 m.store_type, c.season, c.is_holiday, {r('s.units_sold * k.cost_price', 4)} AS cogs, {r('s.total_revenue - s.units_sold * k.cost_price', 4)} AS gross_profit,
 {r('CASE WHEN s.total_revenue > 0 THEN (s.total_revenue - s.units_sold * k.cost_price) / s.total_revenue ELSE 0 END', 6)} AS margin_pct,
 {r('i.ending_inventory * k.cost_price', 4)} AS ending_inventory_value, i.stockout_flag = 1 OR i.ending_inventory = 0 AS is_stockout
FROM sales_daily s JOIN inventory_snapshots i ON s.date = i.date AND s.store_id = i.store_id AND s.sku_id = i.sku_id
LEFT JOIN sku_master k ON s.sku_id = k.sku_id LEFT JOIN store_master m ON s.store_id = m.store_id LEFT JOIN calendar c ON s.date = c.date""")
def d12(t):
    w = star.wide_model(t.sales_daily, t.inventory_snapshots, t.sku_master, t.store_master, t.calendar)
    return w.select(
        "date", "store_id", "sku_id", "units_sold", rnd("total_revenue", 4).alias("total_revenue"), "ending_inventory", "units_sold_inv", "category", "region",
        "store_type", "season", "is_holiday", rnd("cogs", 4).alias("cogs"), rnd("gross_profit", 4).alias("gross_profit"), rnd("margin_pct", 6).alias("margin_pct"),
        rnd("ending_inventory_value", 4).alias("ending_inventory_value"), "is_stockout")


@query("d13_legacy_adapters", f"""
SELECT date, entity_id AS store_id, sku_id, units_sold, {r('revenue', 4)} AS total_revenue, {r('average_unit_price', 6)} AS avg_unit_price, transaction_count,
 unique_customers, promotion_flag FROM forecast_base WHERE source_dataset = 'SYNTHETIC'""")
def d13(t):
    s = star.legacy_sales(t.forecast_base, "SYNTHETIC")
    return s.withColumns({"total_revenue": rnd("total_revenue", 4), "avg_unit_price": rnd("avg_unit_price", 6)})


@query("d14_daily_at_sku_grain", f"""
WITH g AS (SELECT date, sku_id, CAST(sum(units_sold) AS BIGINT) AS units_sold, sum(total_revenue) AS total_revenue, max(promotion_flag) AS promotion_flag
           FROM sales_daily GROUP BY 1, 2),
 m AS (SELECT sku_id, quantile_cont(total_revenue / NULLIF(units_sold, 0), 0.5) AS med FROM g GROUP BY 1)
SELECT date, g.sku_id, units_sold, {r('total_revenue', 4)} AS total_revenue, promotion_flag, {r('COALESCE(total_revenue / NULLIF(units_sold, 0), med)', 6)} AS avg_unit_price
FROM g LEFT JOIN m ON g.sku_id = m.sku_id""")
def d14(t):
    d = star.daily_at_grain(t.daily_units, ["sku_id"])
    return d.withColumns({"total_revenue": rnd("total_revenue", 4), "avg_unit_price": rnd("avg_unit_price", 6)})


WEEKLY = f"week, product_key, units_sold, {r('revenue', 4)} AS revenue, {r('avg_unit_price', 6)} AS avg_unit_price, transaction_count, unique_customers, source_dataset"


def _weekly(df):
    return df.withColumns({"revenue": rnd("revenue", 4), "avg_unit_price": rnd("avg_unit_price", 6)})


@query("d15_weekly_online_demand", f"SELECT {WEEKLY} FROM weekly_online")
def d15(t):
    return _weekly(star.weekly_online(t.retail_log))


@query("d16_weekly_sku_demand", f"SELECT {WEEKLY}, promotion_flag, store_count FROM weekly_sku")
def d16(t):
    return _weekly(star.weekly_sku(t.sales_daily))


@query("d17_weekly_store_sku", f"""
SELECT {week('date')} AS week, store_id, sku_id, {big('sum(units_sold)')} AS units_sold, {r('sum(total_revenue)', 4)} AS revenue, {r('avg(avg_unit_price)', 6)} AS avg_unit_price,
 max(promotion_flag) AS promotion_flag, 'SYNTHETIC' AS source_dataset FROM sales_daily GROUP BY 1, 2, 3""")
def d17(t):
    return _weekly(star.weekly_store_sku(t.sales_daily))


WEEK_STOCK = ("beginning_inventory", "receipts", "units_sold", "ending_inventory", "stockout_flag", "on_order_qty")


@query("d18_weekly_inventory", f"""
SELECT week, sku_id, count(*) AS stores, {', '.join(f'{big(f"sum({c})")} AS {c}' for c in WEEK_STOCK)} FROM weekly_inventory GROUP BY 1, 2""")
def d18(t):
    return t.weekly_inventory.groupBy("week", "sku_id").agg(F.count("*").alias("stores"), *[F.sum(c).alias(c) for c in WEEK_STOCK])


@query("d19_weekly_calendar", "SELECT * FROM weekly_calendar")
def d19(t):
    return t.weekly_calendar
