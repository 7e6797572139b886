"""SQL definitions of the retail tables, independent of the Spark plans."""

from demandloom.functions.vocabulary import HORIZONS
from demandloom.plans.sqltext import week

_BRAND_NO = "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)"
_SEASON = (
    "CASE WHEN month({d}) IN (12, 1, 2) THEN 'Winter' WHEN month({d}) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month({d}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"
)

VIEWS: dict[str, str] = {}

VIEWS["retail_base"] = """
SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN concat('C', CAST(l_orderkey AS VARCHAR))
            WHEN l_returnflag = 'A' AND l_linenumber = 7 AND l_tax >= 0.07 THEN concat('A', CAST(l_orderkey AS VARCHAR))
            ELSE CAST(l_orderkey AS VARCHAR) END AS invoice,
       CAST(l_partkey AS VARCHAR) AS stock_code,
       CASE WHEN l_linenumber = 6 OR l_partkey % 97 = 13 THEN NULL
            WHEN l_linenumber = 3 THEN concat(' ', p_name, ' ', p_type)
            ELSE concat(' ', p_name, ' ') END AS description,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END AS quantity,
       l_shipdate AS invoice_date,
       CASE WHEN l_tax = 0.08 AND l_linenumber = 5 THEN CAST(0 AS DOUBLE)
            WHEN l_tax = 0.08 AND l_linenumber = 7 THEN CAST(-1 AS DOUBLE) ELSE p_retailprice END AS price,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer_id, n_name AS country
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["retail_log"] = """
SELECT * FROM retail_base UNION ALL SELECT * FROM retail_base WHERE CAST(stock_code AS BIGINT) % 31 = 0"""

VIEWS["store_master"] = """
SELECT concat('STORE_', CAST(s_suppkey AS VARCHAR)) AS store_id, s_name AS store_name, n_name AS city, CAST(NULL AS VARCHAR) AS state,
       r_name AS region, CASE WHEN s_suppkey % 2 = 0 THEN 'Standard' ELSE 'Express' END AS store_type,
       CAST(CASE WHEN s_acctbal < 0 THEN 0 ELSE 15000 + (s_suppkey % 40) * 250 END AS INTEGER) AS store_size_sqft,
       DATE '1994-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS opening_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["sku_master"] = f"""
SELECT concat('SKU_', CAST(no AS VARCHAR)) AS sku_id, sku_name,
       CASE WHEN no <> 19 THEN concat('CAT_', CAST(no % 6 AS VARCHAR)) END AS category, concat('SUB_', CAST(no % 9 AS VARCHAR)) AS sub_category,
       p_brand AS brand, base_price * CASE WHEN no = 13 THEN CAST(1.1 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS cost_price, base_price,
       size / CAST(10 AS DOUBLE) AS weight_kg, concat('SUP_', CAST(no % 7 AS VARCHAR)) AS supplier_id,
       CAST(3 + (no * 4) % 25 AS INTEGER) AS lead_time_days, CAST(20 + (no * 11) % 60 AS INTEGER) AS reorder_point,
       CAST(8 + (no * 3) % 20 AS INTEGER) AS safety_stock
FROM (SELECT {_BRAND_NO} AS no, p_brand, min(p_name) AS sku_name, max(p_retailprice) AS base_price, max(p_size) AS size FROM part GROUP BY p_brand) t"""

VIEWS["customer_master"] = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Consumer' WHEN 'AUTOMOBILE' THEN 'Corporate' WHEN 'BUILDING' THEN 'Small Business'
            WHEN 'FURNITURE' THEN 'VIP Loyalty' ELSE c_mktsegment END AS customer_segment,
       CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal >= 0 THEN 0 END AS loyalty_member,
       DATE '1992-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS signup_date
FROM customer"""

VIEWS["sales_daily"] = """
SELECT CAST(l_shipdate AS DATE) AS date, concat('STORE_', CAST(l_suppkey AS VARCHAR)) AS store_id, replace(p_brand, 'Brand#', 'SKU_') AS sku_id,
       CAST(SUM(l_quantity) AS BIGINT) AS units_sold, SUM(l_extendedprice * (1 - l_discount)) AS total_revenue,
       SUM(l_extendedprice * (1 - l_discount)) / NULLIF(SUM(l_quantity), 0) AS avg_unit_price,
       COUNT(DISTINCT l_orderkey) AS transaction_count, COUNT(DISTINCT o_custkey) AS unique_customers,
       MAX(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS promotion_flag
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""

VIEWS["calendar"] = f"""
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN h = 'Regular Day' THEN 0 ELSE 1 END AS is_holiday,
       h AS holiday_name, {_SEASON.format(d='date')} AS season, CAST(weekofyear(date) AS INTEGER) AS week_of_year
FROM (SELECT date, CASE WHEN month(date) = 1 AND day(date) = 1 THEN 'First Day of Year'
             WHEN month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25 THEN 'Spring Bank Day'
             WHEN month(date) = 6 AND isodow(date) = 5 AND day(date) BETWEEN 19 AND 25 THEN 'Midsummer Sale'
             WHEN month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7 THEN 'Labor Day'
             WHEN month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28 THEN 'Harvest Thursday'
             WHEN month(date) = 11 AND isodow(date) = 5 AND day(date) BETWEEN 23 AND 29 THEN 'Sale Friday'
             WHEN month(date) = 12 AND day(date) BETWEEN 24 AND 26 THEN 'Winter Holidays'
             WHEN month(date) = 12 AND day(date) = 31 THEN 'Last Day of Year' ELSE 'Regular Day' END AS h
      FROM (SELECT CAST(unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date FROM lineitem) g) t"""

VIEWS["grid_weeks"] = f"""
SELECT CAST(unnest(generate_series({week('min(l_shipdate)')}, {week('max(l_shipdate)')}, INTERVAL 7 DAY)) AS DATE) AS date FROM lineitem"""

VIEWS["sales_grid"] = f"""
SELECT w.date, k.store_id, k.sku_id, CAST(COALESCE(s.units_sold, 0) AS BIGINT) AS units_sold, COALESCE(s.total_revenue, 0) AS total_revenue,
       COALESCE(s.promotion_flag, 0) AS promotion_flag
FROM grid_weeks w CROSS JOIN (SELECT DISTINCT store_id, sku_id FROM sales_daily) k
LEFT JOIN (SELECT {week('date')} AS date, store_id, sku_id, SUM(units_sold) AS units_sold, SUM(total_revenue) AS total_revenue,
                  MAX(promotion_flag) AS promotion_flag FROM sales_daily GROUP BY 1, 2, 3) s
  ON s.date = w.date AND s.store_id = k.store_id AND s.sku_id = k.sku_id"""

VIEWS["inventory_snapshots"] = """
SELECT date, store_id, sku_id, beginning_inventory, receipts, units_sold,
       CASE WHEN beginning_inventory > units_sold THEN beginning_inventory - units_sold ELSE 0 END AS ending_inventory,
       CASE WHEN units_sold > beginning_inventory THEN 1 ELSE 0 END AS stockout_flag, CASE WHEN day(date) % 3 = 0 THEN 40 ELSE 0 END AS on_order_qty
FROM (SELECT date, store_id, sku_id, units_sold,
             CAST((day(date) * 7 + month(date) * 5 + CAST(substr(sku_id, 5) AS INTEGER) * 11 + CAST(substr(store_id, 7) AS INTEGER) * 13) % 90 AS BIGINT) AS beginning_inventory,
             CAST(CASE WHEN day(date) % 7 = 0 THEN 30 ELSE 0 END AS BIGINT) AS receipts
      FROM (SELECT date, store_id, sku_id, CAST(max(units_sold) AS BIGINT) AS units_sold
            FROM (SELECT date, store_id, sku_id, units_sold FROM sales_daily
                  UNION ALL SELECT least(date + 6, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)), store_id, sku_id, 0 FROM sales_grid) u GROUP BY 1, 2, 3) x) t"""

VIEWS["modal_text"] = """
SELECT stock_code, d AS modal FROM (
  SELECT stock_code, d, row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, d) AS k
  FROM (SELECT stock_code, NULLIF(trim(description), '') AS d FROM retail_log) t WHERE d IS NOT NULL GROUP BY stock_code, d) u WHERE k = 1"""

VIEWS["clean_lines"] = """
SELECT DISTINCT invoice, t.stock_code, COALESCE(d, modal, 'Unknown Product') AS description, quantity, invoice_date, price, customer_id, country,
       d IS NULL AND modal IS NOT NULL AS description_recovered,
       CASE WHEN d IS NOT NULL THEN CASE WHEN d = 'Unknown Product' THEN 'unknown' ELSE 'original' END
            WHEN modal IS NOT NULL THEN 'recovered' ELSE 'unknown' END AS description_source,
       CASE WHEN invoice LIKE 'C%' THEN 'CANCELLATION' WHEN invoice LIKE 'A%' THEN 'INVALID' WHEN quantity < 0 THEN 'RETURN'
            WHEN price < 0 THEN 'INVALID' ELSE 'SALE' END AS transaction_type,
       CAST(invoice_date AS DATE) AS invoice_date_only, CAST(year(invoice_date) AS INTEGER) AS invoice_year,
       CAST(month(invoice_date) AS INTEGER) AS invoice_month, CAST(isodow(invoice_date) - 1 AS INTEGER) AS invoice_weekday,
       customer_id IS NULL AS is_guest_transaction,
       CASE WHEN price < 0 THEN 'PRICE_NEGATIVE' WHEN price = 0 THEN 'PRICE_ZERO' WHEN price > 0 THEN 'PRICE_POSITIVE' ELSE 'PRICE_INVALID' END AS price_category,
       COALESCE(price <= 0, FALSE) AS is_special_transaction
FROM (SELECT *, NULLIF(trim(description), '') AS d FROM retail_log) t LEFT JOIN modal_text m ON t.stock_code = m.stock_code"""

VIEWS["dim_calendar"] = f"""
SELECT *, 'SYNTHETIC' AS date_source FROM calendar
UNION ALL
SELECT date, CAST(year(date) AS INTEGER), CAST(month(date) AS INTEGER), CAST(quarter(date) AS INTEGER), CAST(day(date) AS INTEGER),
       CAST(isodow(date) - 1 AS INTEGER), dayname(date), CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END, 0, NULL, {_SEASON.format(d='date')},
       CAST(weekofyear(date) AS INTEGER), 'UCI_DERIVED'
FROM (SELECT CAST(unnest(generate_series(min(invoice_date_only), max(invoice_date_only), INTERVAL 1 DAY)) AS DATE) AS date
      FROM clean_lines WHERE transaction_type = 'SALE') g WHERE date NOT IN (SELECT date FROM calendar)"""

VIEWS["dim_product"] = """
SELECT concat('SYN_', sku_id) AS product_key, 'SYNTHETIC' AS source_dataset, sku_id, sku_name AS product_name, category, sub_category, brand,
       cost_price, base_price, weight_kg, supplier_id, lead_time_days, reorder_point, safety_stock FROM sku_master
UNION ALL
SELECT concat('UCI_', stock_code), 'UCI', stock_code, description, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT stock_code, description, row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) AS k
      FROM clean_lines WHERE transaction_type <> 'INVALID' GROUP BY 1, 2) t WHERE k = 1"""

VIEWS["dim_entity"] = """
SELECT store_id AS entity_id, 'STORE' AS entity_type, 'SYNTHETIC' AS source_dataset, store_name, city, state, region, store_type,
       CAST(store_size_sqft AS DOUBLE) AS store_size_sqft, opening_date FROM store_master
UNION ALL SELECT 'ONLINE', 'CHANNEL', 'UCI', NULL, NULL, NULL, NULL, NULL, NULL, NULL"""

VIEWS["customer_country"] = """
SELECT customer_id, country FROM (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, country, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, country) AS k
  FROM clean_lines WHERE transaction_type = 'SALE' AND customer_id IS NOT NULL GROUP BY clean_lines.customer_id, country) t WHERE k = 1"""

VIEWS["dim_customer"] = """
SELECT concat('SYN_', customer_id) AS customer_key, 'SYNTHETIC' AS source_dataset, customer_id, customer_name, customer_segment, loyalty_member,
       signup_date, CAST(NULL AS VARCHAR) AS country, FALSE AS is_guest_transaction FROM customer_master
UNION ALL SELECT concat('UCI_', customer_id), 'UCI', customer_id, NULL, NULL, NULL, NULL, country, FALSE FROM customer_country"""

VIEWS["online_sales"] = """
SELECT invoice_date_only AS date, 'UCI' AS source_dataset, 'ONLINE' AS entity_id, 'CHANNEL' AS entity_type, concat('UCI_', stock_code) AS product_key,
       stock_code AS sku_id, CAST(SUM(quantity) AS BIGINT) AS units_sold, SUM(quantity * price) AS revenue,
       SUM(quantity * price) / NULLIF(SUM(quantity), 0) AS average_unit_price, COUNT(DISTINCT invoice) AS transaction_count,
       COUNT(DISTINCT customer_id) AS unique_customers, CAST(NULL AS INTEGER) AS promotion_flag
FROM clean_lines WHERE transaction_type = 'SALE' GROUP BY invoice_date_only, stock_code"""

VIEWS["fact_sales"] = """
SELECT * FROM online_sales UNION ALL
SELECT date, 'SYNTHETIC', store_id, 'STORE', concat('SYN_', sku_id), sku_id, units_sold, total_revenue, avg_unit_price, transaction_count,
       unique_customers, promotion_flag FROM sales_daily"""

VIEWS["fact_inventory"] = """
SELECT date, 'SYNTHETIC' AS source_dataset, store_id AS entity_id, concat('SYN_', sku_id) AS product_key, sku_id, beginning_inventory,
       beginning_inventory - receipts AS beginning_inventory_pre_receipts, receipts, units_sold, ending_inventory, stockout_flag, on_order_qty,
       (beginning_inventory - receipts) + receipts - units_sold = ending_inventory AS inventory_balance_ok FROM inventory_snapshots"""


def _reversal(kind: str, quantity: str, count: str) -> str:
    return f"""
SELECT invoice_date_only AS date, 'UCI' AS source_dataset, 'ONLINE' AS entity_id, 'CHANNEL' AS entity_type, concat('UCI_', stock_code) AS product_key,
       stock_code AS sku_id, SUM(abs(quantity)) AS {quantity}, COUNT(DISTINCT invoice) AS {count}, SUM(quantity * price) AS revenue_impact
FROM clean_lines WHERE transaction_type = '{kind}' GROUP BY invoice_date_only, stock_code"""


VIEWS["fact_returns"] = _reversal("RETURN", "quantity_returned", "return_transactions")
VIEWS["fact_cancellations"] = _reversal("CANCELLATION", "cancelled_quantity", "cancellation_transactions")

VIEWS["customer_analytics"] = """
SELECT concat('UCI_', t.customer_id) AS customer_key, 'UCI' AS source_dataset, t.customer_id, CAST(NULL AS VARCHAR) AS customer_segment,
       CAST(NULL AS INTEGER) AS loyalty_member, CAST(NULL AS DATE) AS signup_date, country, transaction_count, total_units, total_revenue,
       first_purchase_date, last_purchase_date
FROM (SELECT CAST(customer_id AS VARCHAR) AS customer_id, COUNT(DISTINCT invoice) AS transaction_count, CAST(SUM(quantity) AS BIGINT) AS total_units,
             SUM(quantity * price) AS total_revenue, MIN(invoice_date_only) AS first_purchase_date, MAX(invoice_date_only) AS last_purchase_date
      FROM clean_lines WHERE transaction_type = 'SALE' AND customer_id IS NOT NULL GROUP BY clean_lines.customer_id) t
LEFT JOIN customer_country c ON t.customer_id = c.customer_id
UNION ALL
SELECT concat('SYN_', customer_id), 'SYNTHETIC', customer_id, customer_segment, loyalty_member, signup_date, NULL, NULL, NULL, NULL, NULL, NULL FROM customer_master"""

VIEWS["inventory_analytics"] = """
SELECT f.date, f.source_dataset, f.entity_id, f.product_key, f.sku_id, category, sub_category, brand, ending_inventory, on_order_qty, stockout_flag,
       lead_time_days, reorder_point, safety_stock FROM fact_inventory f LEFT JOIN dim_product p ON f.product_key = p.product_key"""

VIEWS["forecast_base"] = """
SELECT date, source_dataset, entity_id, entity_type, product_key, sku_id, units_sold, revenue, average_unit_price, transaction_count,
       unique_customers, promotion_flag FROM fact_sales"""

VIEWS["weekly_online"] = f"""
SELECT {week('invoice_date')} AS week, concat('UCI_', stock_code) AS product_key, CAST(SUM(quantity) AS BIGINT) AS units_sold,
       SUM(quantity * price) AS revenue, AVG(price) AS avg_unit_price, COUNT(DISTINCT invoice) AS transaction_count,
       COUNT(DISTINCT customer_id) AS unique_customers, 'UCI' AS source_dataset, CAST(NULL AS INTEGER) AS promotion_flag, CAST(NULL AS BIGINT) AS store_count
FROM (SELECT DISTINCT * FROM retail_log WHERE invoice NOT LIKE 'C%' AND quantity > 0 AND price > 0 AND invoice_date IS NOT NULL) t
GROUP BY 1, 2 HAVING SUM(quantity) > 0"""

VIEWS["weekly_sku"] = f"""
SELECT {week('date')} AS week, concat('SYN_', sku_id) AS product_key, CAST(SUM(units_sold) AS BIGINT) AS units_sold, SUM(total_revenue) AS revenue,
       AVG(avg_unit_price) AS avg_unit_price, CAST(SUM(transaction_count) AS BIGINT) AS transaction_count,
       CAST(SUM(unique_customers) AS BIGINT) AS unique_customers, 'SYNTHETIC' AS source_dataset, MAX(promotion_flag) AS promotion_flag,
       COUNT(DISTINCT store_id) AS store_count FROM sales_daily GROUP BY 1, 2"""

VIEWS["weekly_demand"] = "SELECT * FROM weekly_online UNION ALL SELECT * FROM weekly_sku"

VIEWS["weekly_calendar"] = f"""
SELECT week, is_holiday_week, holiday_count, holiday_names, season, month, CAST(season = 'Winter' AS INTEGER) AS season_Winter,
       CAST(season = 'Spring' AS INTEGER) AS season_Spring, CAST(season = 'Summer' AS INTEGER) AS season_Summer, CAST(season = 'Fall' AS INTEGER) AS season_Fall
FROM (SELECT {week('date')} AS week, MAX(is_holiday) AS is_holiday_week, CAST(SUM(is_holiday) AS BIGINT) AS holiday_count,
             COALESCE(string_agg(DISTINCT holiday_name, ', ' ORDER BY holiday_name) FILTER (WHERE holiday_name <> 'Regular Day'), '') AS holiday_names,
             arg_min(season, date) AS season, arg_min(month, date) AS month FROM calendar GROUP BY 1) t"""

VIEWS["weekly_inventory"] = f"""
SELECT {week('date')} AS week, store_id, sku_id, arg_max(beginning_inventory, date) AS beginning_inventory, arg_max(receipts, date) AS receipts,
       arg_max(units_sold, date) AS units_sold, arg_max(ending_inventory, date) AS ending_inventory, arg_max(stockout_flag, date) AS stockout_flag,
       arg_max(on_order_qty, date) AS on_order_qty FROM inventory_snapshots GROUP BY 1, 2, 3"""

VIEWS["panel_rows"] = """
SELECT 'SYNTHETIC' AS source_dataset, store_id AS entity_id, concat('SYN_', sku_id) AS product_key, date, CAST(units_sold AS DOUBLE) AS units_sold,
       total_revenue AS revenue FROM sales_grid
UNION ALL SELECT source_dataset, entity_id, product_key, date, CAST(units_sold AS DOUBLE), revenue FROM online_sales"""

SPLIT = """
SELECT b.*, CASE WHEN date < lo + CAST(floor((hi - lo) * CAST(0.8 AS DOUBLE)) AS INTEGER) THEN 'train'
                 WHEN date < lo + CAST(floor((hi - lo) * CAST(0.9 AS DOUBLE)) AS INTEGER) THEN 'validation' ELSE 'test' END AS split
FROM {t} b JOIN (SELECT source_dataset, min(date) AS lo, max(date) AS hi FROM {t} GROUP BY 1) s ON b.source_dataset = s.source_dataset"""

VIEWS["panel"] = SPLIT.format(t="panel_rows")

_W = "PARTITION BY source_dataset, entity_id, product_key ORDER BY date"
VIEWS["baseline_predictions"] = f"""
SELECT *, lag(units_sold, 1) OVER w AS naive, lag(units_sold, 7) OVER w AS seasonal_naive,
       avg(units_sold) OVER ({_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS moving_average_7,
       avg(units_sold) OVER ({_W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS moving_average_14,
       avg(units_sold) OVER ({_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS moving_average_30,
       avg(units_sold) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS historical_mean
FROM panel WINDOW w AS ({_W})"""

MODELS = ("naive", "seasonal_naive", "moving_average_7", "moving_average_14", "moving_average_30", "historical_mean")
VIEWS["long_predictions"] = " UNION ALL ".join(
    f"SELECT source_dataset, entity_id, product_key, date, split, units_sold, revenue, '{m}' AS model, {m} AS prediction "
    "FROM baseline_predictions WHERE split IN ('validation', 'test')" for m in MODELS
)


def _horizon(h: int) -> str:
    frame = f"({_W} ROWS BETWEEN {h + 6} PRECEDING AND {h} PRECEDING)"
    return f"""SELECT source_dataset, entity_id, product_key, date AS forecast_date, lag(date, {h}) OVER ({_W}) AS origin_date, {h} AS horizon,
       units_sold AS actual, split, avg(units_sold) OVER {frame} AS prediction, stddev_samp(units_sold) OVER {frame} AS spread FROM panel"""


VIEWS["forecast_rows"] = f"""
SELECT source_dataset, entity_id, product_key, forecast_date, origin_date, horizon, actual, prediction,
       CASE WHEN spread IS NOT NULL THEN greatest(prediction - CAST(1.28 AS DOUBLE) * spread, 0) END AS lower_bound,
       prediction + CAST(1.28 AS DOUBLE) * spread AS upper_bound,
       'moving_average_7' AS model_name, 'v1' AS model_version
FROM ({' UNION ALL '.join(_horizon(h) for h in HORIZONS)}) t WHERE split = 'test' AND prediction IS NOT NULL"""

VIEWS["week_index"] = """
SELECT source_dataset, week, row_number() OVER (PARTITION BY source_dataset ORDER BY week) - 1 AS idx, count(*) OVER (PARTITION BY source_dataset) AS n
FROM (SELECT DISTINCT source_dataset, week FROM weekly_demand) t"""

VIEWS["fold_origins"] = """
SELECT source_dataset, week AS origin, idx AS origin_idx, row_number() OVER (PARTITION BY source_dataset ORDER BY idx) - 1 AS fold
FROM week_index WHERE idx >= 52 AND n - 8 - idx >= 0 AND n - 8 - idx < CASE WHEN n < 65 THEN greatest(1, n - 60) ELSE 5 END"""

# train and test rows are paired per fold and counted, as the definition reads
VIEWS["fold_train"] = """
SELECT d.source_dataset, d.product_key, o.fold, o.origin, o.origin_idx, count(*) AS train_len,
       list(CAST(d.units_sold AS DOUBLE) ORDER BY d.week) AS history
FROM weekly_demand d JOIN fold_origins o ON d.source_dataset = o.source_dataset AND d.week <= o.origin GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 13"""

VIEWS["backtest"] = """
SELECT source_dataset, product_key, fold, forecast_origin, forecast_week, horizon_step, actual,
       greatest(0, CASE WHEN train_len - 52 + horizon_step >= 1 THEN history[train_len - 52 + horizon_step] ELSE history[train_len] END) AS seasonal_naive_forecast,
       greatest(0, list_avg(history[train_len - 3:train_len])) AS candidate_forecast
FROM (SELECT t.source_dataset, t.product_key, t.fold, t.origin AS forecast_origin, d.week AS forecast_week, t.train_len, t.history,
             row_number() OVER (PARTITION BY t.source_dataset, t.product_key, t.fold ORDER BY d.week) AS horizon_step, CAST(d.units_sold AS DOUBLE) AS actual
      FROM fold_train t JOIN week_index w ON w.source_dataset = t.source_dataset AND w.idx > t.origin_idx AND w.idx <= t.origin_idx + 8
      JOIN weekly_demand d ON d.source_dataset = t.source_dataset AND d.product_key = t.product_key AND d.week = w.week) x"""

VIEWS["recent_demand"] = """
SELECT store_id, sku_id, avg(units_sold) AS avg_daily_demand, COALESCE(stddev_samp(units_sold), 0) AS std_daily_demand,
       CAST(sum(units_sold) AS BIGINT) AS total_recent_units, sum(total_revenue) AS total_recent_revenue, avg(avg_unit_price) AS avg_price
FROM sales_daily WHERE date >= (SELECT max(date) - 30 FROM sales_daily) GROUP BY 1, 2"""

VIEWS["risk_base"] = """
SELECT i.*, COALESCE(r.avg_daily_demand, CAST(0.1 AS DOUBLE)) AS avg_daily_demand, COALESCE(r.std_daily_demand, 0) AS std_daily_demand,
       r.total_recent_units, r.total_recent_revenue, r.avg_price, k.sku_name, k.category, k.cost_price, k.base_price, k.supplier_id, k.lead_time_days,
       k.reorder_point, k.safety_stock, greatest(COALESCE(r.avg_daily_demand, CAST(0.1 AS DOUBLE)), CAST(0.05 AS DOUBLE)) AS effective_daily_demand,
       ending_inventory / greatest(COALESCE(r.avg_daily_demand, CAST(0.1 AS DOUBLE)), CAST(0.05 AS DOUBLE)) AS days_of_supply
FROM inventory_snapshots i LEFT JOIN recent_demand r ON i.store_id = r.store_id AND i.sku_id = r.sku_id
LEFT JOIN sku_master k ON i.sku_id = k.sku_id WHERE i.date = (SELECT max(date) FROM inventory_snapshots)"""

VIEWS["risk_scores"] = """
SELECT *, round_even(CASE WHEN ending_inventory <= 0 THEN CAST(100 AS DOUBLE)
   WHEN ending_inventory < safety_stock THEN 75 + (1 - ending_inventory / CAST(greatest(1, safety_stock) AS DOUBLE)) * 20
   WHEN days_of_supply < lead_time_days THEN 50 + (1 - days_of_supply / greatest(1, lead_time_days)) * 24
   WHEN ending_inventory + on_order_qty <= reorder_point THEN 35 ELSE 0 END * 10, 0) / 10 AS stockout_risk_score,
 round_even(CASE WHEN avg_daily_demand < 0.5 THEN least(100, least(greatest(0, days_of_supply - 45) / 45 * 50, 100) + 25)
   ELSE least(greatest(0, days_of_supply - 45) / 45 * 50, 100) END * CAST(10 AS DOUBLE), 0) / 10 AS overstock_risk_score,
 CAST(greatest(0, ending_inventory - round_even(effective_daily_demand * 45, 0)) AS BIGINT) AS excess_units,
 CASE WHEN ending_inventory <= 0 THEN effective_daily_demand * base_price ELSE 0 END AS potential_lost_daily_revenue,
 ending_inventory <= reorder_point AS reorder_triggered, ending_inventory + on_order_qty <= reorder_point AS rop_position_triggered,
 CASE WHEN ending_inventory <= reorder_point THEN CAST(greatest(10, round_even(effective_daily_demand * (lead_time_days + 14) + safety_stock - ending_inventory, 0)) AS BIGINT)
      ELSE 0 END AS recommended_reorder_qty FROM risk_base"""

VIEWS["risk_matrix"] = """
SELECT *, CASE WHEN stockout_risk_score >= 70 THEN 'CRITICAL / HIGH' WHEN stockout_risk_score >= 35 THEN 'MEDIUM (REORDER)' ELSE 'LOW / SAFE' END AS stockout_risk_level,
 CASE WHEN overstock_risk_score >= 65 THEN 'SEVERE OVERSTOCK' WHEN overstock_risk_score >= 30 THEN 'MODERATE OVERSTOCK' ELSE 'OPTIMAL' END AS overstock_risk_level,
 excess_units * cost_price AS capital_tied_up, excess_units * cost_price * CAST(0.25 AS DOUBLE) AS annual_holding_cost,
 recommended_reorder_qty * cost_price AS recommended_order_spend,
 CASE WHEN reorder_triggered AND on_order_qty > 0 THEN 'Shelf at/below ROP; on-order qty in transit — draft review only, not a supplier PO.'
      WHEN reorder_triggered THEN 'Shelf at/below ROP — draft review only, not a supplier PO.' ELSE '' END AS replenishment_note FROM risk_scores"""

VIEWS["sku_forecast"] = """
SELECT product_key, avg(candidate_forecast) AS forecast_weekly_demand FROM backtest WHERE source_dataset = 'SYNTHETIC' GROUP BY 1"""

VIEWS["sku_position"] = """
SELECT i.sku_id, i.on_hand_units, i.on_order_units, k.lead_time_days, k.reorder_point, k.safety_stock, k.cost_price, k.base_price,
       COALESCE(f.forecast_weekly_demand, CAST(0.1 AS DOUBLE)) AS demand, CAST(ceil(COALESCE(k.lead_time_days, 14) / CAST(7 AS DOUBLE)) AS INTEGER) AS lead
FROM (SELECT sku_id, CAST(sum(ending_inventory) AS BIGINT) AS on_hand_units, CAST(sum(on_order_qty) AS BIGINT) AS on_order_units FROM weekly_inventory
      WHERE week = (SELECT max(week) FROM weekly_inventory) GROUP BY 1) i
LEFT JOIN sku_master k ON i.sku_id = k.sku_id LEFT JOIN sku_forecast f ON f.product_key = concat('SYN_', i.sku_id)"""


def scored(table: str, horizon: int) -> str:
    """Weekly risk scores and grid over on_hand_units, on_order_units, demand, lead, safety_stock, reorder_point."""
    return f"""
SELECT *, CASE WHEN stockout_risk_level = 'CRITICAL' THEN 'REORDER NOW' WHEN overstock_risk_level = 'SEVERE' THEN 'MARKDOWN / CLEAR'
     WHEN stockout_risk_level = 'MEDIUM' OR overstock_risk_level = 'MODERATE' THEN 'WATCH / VOLATILE' ELSE 'HEALTHY' END AS recommended_action
FROM (SELECT *, CASE WHEN stockout_risk_score >= 70 THEN 'CRITICAL' WHEN stockout_risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS stockout_risk_level,
       CASE WHEN overstock_risk_score >= 65 THEN 'SEVERE' WHEN overstock_risk_score >= 30 THEN 'MODERATE' ELSE 'OPTIMAL' END AS overstock_risk_level
 FROM (SELECT *, CAST(CASE WHEN on_hand_units <= 0 THEN 100 WHEN on_hand_units < safety_stock THEN 80 WHEN wos < lead THEN 60
            WHEN on_hand_units + on_order_units <= reorder_point THEN 40 ELSE 0 END AS DOUBLE) AS stockout_risk_score,
        CAST(CASE WHEN demand < 0.5 THEN least(100, CASE WHEN wos > {horizon * 2} THEN 80 WHEN wos > {horizon} THEN 50 ELSE 0 END + 20)
             WHEN wos > {horizon * 2} THEN 80 WHEN wos > {horizon} THEN 50 ELSE 0 END AS DOUBLE) AS overstock_risk_score,
        demand * lead AS lead_time_demand, on_hand_units + on_order_units AS inventory_position, greatest(0, on_hand_units - demand * {horizon}) AS excess
  FROM (SELECT *, on_hand_units / greatest(demand, CAST(0.01 AS DOUBLE)) AS wos FROM {table}) a) b) c"""


VIEWS["sku_scored"] = scored("sku_position", 6)
_R2 = "round_even(({0}) * CAST(100 AS DOUBLE), 0) / 100"
VIEWS["sku_risk"] = f"""
SELECT sku_id, {_R2.format('demand')} AS forecast_weekly_demand, {_R2.format('lead_time_demand')} AS lead_time_demand, on_hand_units, on_order_units,
       safety_stock, inventory_position, {_R2.format('inventory_position - lead_time_demand')} AS projected_balance, {_R2.format('wos')} AS weeks_of_supply,
       stockout_risk_score, stockout_risk_level, overstock_risk_score, overstock_risk_level, recommended_action,
       CASE WHEN stockout_risk_level IN ('CRITICAL', 'MEDIUM') THEN {_R2.format('lead_time_demand * base_price')} END AS sales_at_risk,
       CASE WHEN excess > 0 THEN {_R2.format('excess * cost_price')} END AS locked_capital FROM sku_scored"""
