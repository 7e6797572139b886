"""Data-quality queries."""

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.functions.vocabulary import DAILY_LAGS, DAILY_WINDOWS
from demandloom.operators import features, quality, star
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, ci, pct, r

LOG = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country"]


@query("q1_contract", f"""
SELECT 'retail_log' AS dataset, 'state' AS missing_columns, 'country' AS extra_columns, FALSE AS schema_ok, count(*) AS row_count, count(*) = 0 AS is_empty,
 {ci('invoice IS NULL OR customer_id IS NULL')} AS null_key_rows FROM retail_log""")
def q1(t):
    return quality.contract(t.retail_log, [*LOG[:-1], "state"], ["invoice", "customer_id"], "retail_log")


@query("q2_exact_duplicates", f"""
SELECT 'retail_log' AS dataset, a AS original_rows, b AS final_rows, a - b AS duplicate_rows, {pct('a - b', 'a')} AS duplicate_pct
FROM (SELECT (SELECT count(*) FROM retail_log) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM retail_log) d) AS b) t""")
def q2(t):
    return quality.duplicates(t.retail_log, LOG, "retail_log")


@query("q3_date_profile", f"""
SELECT 'retail_log' AS dataset, {ci('invoice_date IS NULL')} AS missing_dates, {big('0')} AS invalid_dates, {ci("CAST(invoice_date AS DATE) > DATE '2001-01-01'")} AS future_dates,
 CAST(min(invoice_date) AS DATE) AS min_date, CAST(max(invoice_date) AS DATE) AS max_date, date_diff('day', CAST(min(invoice_date) AS DATE), CAST(max(invoice_date) AS DATE)) AS total_days
FROM retail_log""")
def q3(t):
    return quality.date_profile(t.retail_log, "invoice_date", "retail_log", "2001-01-01")


def _num(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS non_null, {ci(f'{c} < 0')} AS negative, {ci(f'{c} = 0')} AS zero, {ci(f'{c} > 0')} AS positive,
 CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {r(f'avg({c})', 6)} AS mean, 'retail_log' AS dataset FROM retail_log"""


@query("q4_numeric_profile", f"{_num('quantity')} UNION ALL {_num('price')} UNION ALL {_num('customer_id')}")
def q4(t):
    return quality.numeric_profile(t.retail_log, ["quantity", "price", "customer_id"], "retail_log")


@query("q5_missing_values", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT 'retail_log' AS dataset, '{c}' AS "column", count(*) - count({c}) AS missing_count, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct FROM retail_log"""
    for c in LOG) + ") u WHERE missing_count > 0")
def q5(t):
    return quality.missing_values(t.retail_log, "retail_log", LOG)


def _out(c):
    return f"""SELECT '{c}' AS "column", count(v) AS n, max(q1) AS q1, max(q3) AS q3, max(lo) AS lower_bound, max(hi) AS upper_bound, {ci('v < lo OR v > hi')} AS iqr_outlier_count,
 min(CASE WHEN v < lo OR v > hi THEN v END) AS iqr_outlier_min, max(CASE WHEN v < lo OR v > hi THEN v END) AS iqr_outlier_max, {ci('abs((v - m) / s) > 3')} AS z_outlier_count,
 min(CASE WHEN abs((v - m) / s) > 3 THEN v END) AS z_outlier_min, max(CASE WHEN abs((v - m) / s) > 3 THEN v END) AS z_outlier_max, 'retail_log' AS dataset,
 {pct('count_if(v < lo OR v > hi)', 'count(v)')} AS iqr_outlier_pct, {pct('count_if(abs((v - m) / s) > 3)', 'count(v)')} AS z_outlier_pct
 FROM (SELECT {c} AS v, q1, q3, m, s, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi FROM retail_log,
   (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM retail_log) b) t"""


@query("q6_outliers", f"SELECT * REPLACE ({r('q1', 4)} AS q1, {r('q3', 4)} AS q3, {r('lower_bound', 4)} AS lower_bound, {r('upper_bound', 4)} AS upper_bound) FROM ({_out('quantity')} UNION ALL {_out('price')}) u")
def q6(t):
    o = quality.outliers(t.retail_log, ["quantity", "price"], "retail_log")
    return o.withColumns({c: rnd(c, 4) for c in ("q1", "q3", "lower_bound", "upper_bound")})


@query("q7_referential_integrity", """
SELECT 'retail_log' AS child_dataset, 'discount_parts' AS parent_dataset, count(*) AS total_child_rows, CAST(count_if(ok) AS BIGINT) AS valid_relationships, CAST(count_if(NOT ok) AS BIGINT) AS orphan_records,
 (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT stock_code AS v FROM retail_log WHERE stock_code NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 3) ORDER BY v LIMIT 50) s) AS orphan_values
FROM (SELECT stock_code IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 3) AS ok FROM retail_log) t""")
def q7(t):
    return quality.referential(t.retail_log, "stock_code", t.table("part").where("p_size > 3"), "p_partkey", "retail_log", "discount_parts")


@query("q8_grain", f"""
SELECT 'retail_log' AS table_name, 'invoice+stock_code+customer_id' AS grain, count(*) AS row_count,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT invoice, stock_code, customer_id FROM retail_log) d) AS duplicate_key_count, {ci('customer_id IS NULL')} AS null_key_count FROM retail_log""")
def q8(t):
    return quality.grain(t.retail_log, ["invoice", "stock_code", "customer_id"], "retail_log")


def _tables(t):
    return {n: getattr(t, n) for n in quality.GRAINS}


def _orphan_sql(f, d, k):
    cond = " AND ".join(f"f.{c} = d.{c}" for c in k)
    return f"""SELECT '{f}' AS fact, '{d}' AS dim, '{'+'.join(k)}' AS keys, count(*) AS orphan_count FROM {f} f WHERE NOT EXISTS (SELECT 1 FROM {d} d WHERE {cond})"""


@query("q9_foreign_keys", " UNION ALL ".join(_orphan_sql(*rel) for rel in quality.RELATIONS))
def q9(t):
    return quality.star_orphans(_tables(t))


def _dups(table, key):
    return f"(SELECT count(*) - count(DISTINCT {key}) FROM {table})"


def _verdict(inner, checks):
    total = " + ".join(checks)
    return f"SELECT *, {total} AS invalid_values, CASE WHEN {total} > 0 THEN 'REVIEW' ELSE 'PASS' END AS quality_status FROM ({inner}) v"


@query("q10_store_rules", _verdict(f"""
SELECT count(*) AS original_rows, {ci('store_id IS NULL')} AS missing_ids, {ci('store_size_sqft <= 0')} AS invalid_store_sizes, {ci("opening_date > DATE '2025-12-31'")} AS invalid_opening_dates,
 {_dups('store_master', 'store_id')} AS duplicate_ids FROM store_master""", ["duplicate_ids", "missing_ids", "invalid_store_sizes", "invalid_opening_dates"]))
def q10(t):
    return quality.store_rules(t.store_master)


SKU_RULES = {
    "invalid_cost_price": "cost_price <= 0", "invalid_base_price": "base_price <= 0", "invalid_weight_kg": "weight_kg <= 0", "invalid_lead_time_days": "lead_time_days <= 0",
    "negative_reorder_point": "reorder_point < 0", "negative_safety_stock": "safety_stock < 0", "missing_category": "category IS NULL", "missing_supplier": "supplier_id IS NULL",
    "cost_price_ge_base_price": "cost_price >= base_price",
}


@query("q11_sku_rules", _verdict(f"""
SELECT count(*) AS original_rows, {ci('sku_id IS NULL')} AS missing_ids, {', '.join(f'{ci(c)} AS {n}' for n, c in SKU_RULES.items())}, {_dups('sku_master', 'sku_id')} AS duplicate_ids FROM sku_master""",
    ["duplicate_ids", "missing_ids", *SKU_RULES]))
def q11(t):
    return quality.sku_rules(t.sku_master)


@query("q12_customer_rules", _verdict(f"""
SELECT count(*) AS original_rows, {ci('customer_id IS NULL')} AS missing_ids, {ci('loyalty_member IS NULL OR loyalty_member NOT IN (0, 1)')} AS invalid_loyalty_member,
 {ci("customer_segment IS NULL OR customer_segment NOT IN ('Consumer', 'Corporate', 'Small Business', 'VIP Loyalty')")} AS invalid_segment, {ci("signup_date > DATE '2025-12-31'")} AS invalid_signup_dates,
 {_dups('customer_master', 'customer_id')} AS duplicate_ids FROM customer_master""", ["duplicate_ids", "missing_ids", "invalid_loyalty_member", "invalid_segment", "invalid_signup_dates"]))
def q12(t):
    return quality.customer_rules(t.customer_master)


CAL = {
    "year": "year IS DISTINCT FROM year(date)", "month": "month IS DISTINCT FROM month(date)", "day": "day IS DISTINCT FROM day(date)",
    "quarter": "quarter IS DISTINCT FROM quarter(date)", "week_of_year": "week_of_year IS DISTINCT FROM weekofyear(date)", "day_of_week": "day_of_week IS DISTINCT FROM isodow(date) - 1",
    "is_weekend": "is_weekend IS DISTINCT FROM CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END", "is_holiday": "is_holiday IS NULL OR is_holiday NOT IN (0, 1)",
}


@query("q13_calendar_rules", _verdict(f"""
SELECT count(*) AS original_rows, {ci('date IS NULL')} AS missing_ids, {', '.join(f'{ci(c)} AS "{n}"' for n, c in CAL.items())}, {_dups('calendar', 'date')} AS duplicate_ids
FROM (SELECT * REPLACE (CASE WHEN day = 31 THEN 0 ELSE quarter END AS quarter, CASE WHEN is_holiday = 1 THEN 9 ELSE day_of_week END AS day_of_week) FROM calendar) c""",
    ["duplicate_ids", "missing_ids", *[f'"{c}"' for c in CAL]]))
def q13(t):
    raw = t.calendar.withColumns({
        "quarter": F.when(F.col("day") == 31, 0).otherwise(F.col("quarter")), "day_of_week": F.when(F.col("is_holiday") == 1, 9).otherwise(F.col("day_of_week"))})
    return quality.calendar_rules(raw)


@query("q14_sales_rules", _verdict(f"""
SELECT count(*) AS original_rows, {ci('promotion_flag NOT IN (0, 1)')} AS invalid_promotion_flags, {ci(f"abs(total_revenue - {r('units_sold * avg_unit_price', 2)}) > 0.01")} AS revenue_mismatch_rows,
 {ci('units_sold = 0')} AS zero_unit_rows, {big('0')} AS duplicate_grain, {ci("store_id NOT IN (SELECT store_id FROM store_master WHERE store_size_sqft > 0)")} AS orphan_store_ids,
 {ci('sku_id NOT IN (SELECT sku_id FROM sku_master)')} AS orphan_sku_ids, {ci('date NOT IN (SELECT date FROM calendar)')} AS orphan_dates FROM sales_daily""",
    ["duplicate_grain", "orphan_store_ids", "orphan_sku_ids", "orphan_dates", "invalid_promotion_flags", "revenue_mismatch_rows"]))
def q14(t):
    return quality.sales_rules(t.sales_daily, t.store_master.where("store_size_sqft > 0"), t.sku_master, t.calendar)


@query("q15_inventory_balance", f"""
SELECT count(*) AS original_rows, {ci('stockout_flag NOT IN (0, 1)')} AS invalid_stockout_flags, {ci('beginning_inventory + receipts - i.units_sold <> ending_inventory')} AS canonical_equation_mismatch_rows,
 {ci('ending_inventory = beginning_inventory - i.units_sold')} AS ending_equals_beginning_minus_sold_rows, {ci('beginning_inventory - i.units_sold = ending_inventory')} AS derived_balance_ok_rows,
 count(s.units_sold) AS cross_checked_rows, {ci('s.units_sold <> i.units_sold')} AS cross_sales_mismatch_rows,
 {pct('count_if(beginning_inventory + receipts - i.units_sold <> ending_inventory)', 'count(*)')} AS canonical_equation_mismatch_pct
FROM inventory_snapshots i LEFT JOIN sales_daily s ON i.date = s.date AND i.store_id = s.store_id AND i.sku_id = s.sku_id""")
def q15(t):
    return quality.inventory_rules(t.inventory_snapshots, t.daily_units)


def _rule(name, table, scope, bad):
    return f"SELECT '{name}' AS rule, {ci(scope)} AS checked, {ci(f'({scope}) AND ({bad})')} AS violations FROM {table}"


RULES = [
    ("inventory_equation_ending_eq_beginning_minus_units_sold", "fact_inventory", "inventory_balance_ok", "ending_inventory <> beginning_inventory - units_sold"),
    ("receipts_not_readded_to_ending", "fact_inventory", "inventory_balance_ok AND receipts > 0", "ending_inventory = beginning_inventory + receipts - units_sold"),
    ("inventory_synthetic_only", "fact_inventory", "TRUE", "source_dataset <> 'SYNTHETIC'"), ("sales_units_nonnegative", "fact_sales", "TRUE", "units_sold < 0"),
    ("source_dataset_enum_valid", "fact_sales", "TRUE", "source_dataset NOT IN ('UCI', 'SYNTHETIC')"),
    ("uci_promotion_flag_null_not_invented", "fact_sales", "source_dataset = 'UCI'", "promotion_flag IS NOT NULL"),
    ("returns_separated_from_sales", "fact_returns", "TRUE", "source_dataset <> 'UCI'"), ("cancellations_separated_from_sales", "fact_cancellations", "TRUE", "source_dataset <> 'UCI'"),
    ("positive_cancellations_preserved", "fact_cancellations", "revenue_impact > 0", "cancelled_quantity <= 0"),
    ("customer_analytics_no_null_customer_key", "customer_analytics", "TRUE", "customer_key IS NULL"),
    ("forecast_base_has_no_lag_rolling_features", "forecast_base", "TRUE", "FALSE"),
]


@query("q16_business_rules", "SELECT *, violations = 0 AS passed FROM (" + " UNION ALL ".join(_rule(*x) for x in RULES) + ") u")
def q16(t):
    return quality.business_rules(_tables(t))


def _report(table, keys, ncols):
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    fks = [_orphan_sql(*rel) for rel in quality.RELATIONS if rel[0] == table]
    viol = f"(SELECT {big('sum(orphan_count)')} FROM ({' UNION ALL '.join(fks)}) o)" if fks else big("0")
    return f"""SELECT '{table}' AS table_name, '{'+'.join(keys)}' AS grain, count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {table}) d) AS duplicate_key_count,
 {ci(null)} AS null_key_count, {ncols} AS column_count, {viol} AS foreign_key_violations FROM {table}"""


WIDTHS = {"dim_calendar": 13, "dim_product": 14, "dim_entity": 10, "dim_customer": 9, "fact_sales": 12, "fact_inventory": 13, "fact_returns": 9, "fact_cancellations": 9,
          "inventory_analytics": 14, "customer_analytics": 12, "forecast_base": 12}


@query("q17_integration_report", "SELECT *, CASE WHEN duplicate_key_count + null_key_count + foreign_key_violations > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM (" +
       " UNION ALL ".join(_report(n, k, WIDTHS[n]) for n, k in quality.GRAINS.items()) + ") u")
def q17(t):
    return quality.integration_report(_tables(t))


FLAT = {"retail_log": (LOG, "invoice_date"), "store_master": (["store_id", "store_name", "city", "state", "region", "store_type", "store_size_sqft", "opening_date"], None),
        "customer_master": (["customer_id", "customer_name", "customer_segment", "loyalty_member", "signup_date"], "signup_date"),
        "sku_master": (["sku_id", "sku_name", "category", "sub_category", "brand", "cost_price", "base_price", "weight_kg", "supplier_id", "lead_time_days", "reorder_point", "safety_stock"], None)}


def _flat(name, columns, day):
    cells = " + ".join(f"(count(*) - count({c}))" for c in columns)
    lo, hi = (f"CAST(min({day}) AS DATE)", f"CAST(max({day}) AS DATE)") if day else ("CAST(NULL AS DATE)", "CAST(NULL AS DATE)")
    return f"""SELECT count(*) AS original_rows, {cells} AS missing_values, {lo} AS min_date, {hi} AS max_date, '{name}' AS dataset, {len(columns)} AS columns,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name}) d) AS duplicates_found FROM {name}"""


@query("q18_flat_report", " UNION ALL ".join(_flat(n, c, d) for n, (c, d) in FLAT.items()))
def q18(t):
    return quality.flat_report({n: (getattr(t, n), d) for n, (_, d) in FLAT.items()})


def _prof(c):
    return f"""SELECT 'customer_master' AS dataset, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing_count, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct,
 count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer_master"""


@query("q19_dataset_profile", " UNION ALL ".join(_prof(c) for c in FLAT["customer_master"][0]))
def q19(t):
    return quality.profile(t.customer_master, "customer_master")


@query("q20_log_checks", f"""
SELECT count(*) AS rows, {ci('description IS NULL')} AS null_description, {ci('customer_id IS NULL')} AS null_customer_id, {ci('quantity < 0')} AS negative_quantity, {ci('quantity = 0')} AS zero_quantity,
 {ci('price = 0')} AS zero_price, {ci('price < 0')} AS negative_price, {ci("invoice LIKE 'C%'")} AS cancellation_lines, count(DISTINCT invoice) AS invoices, count(DISTINCT stock_code) AS products,
 count(DISTINCT customer_id) AS customers, count(DISTINCT country) AS countries FROM retail_log""")
def q20(t):
    return quality.log_checks(t.retail_log)


def _match(dim, table, key):
    ok = f"{key} IN (SELECT {key} FROM {table})"
    return f"SELECT 'sales_daily' AS fact, '{dim}' AS dim, count(*) AS rows, {ci(ok)} AS matched, {pct(f'count_if({ok})', 'count(*)')} AS match_rate_pct FROM sales_daily"


@query("q21_match_rate", " UNION ALL ".join([_match("sized_stores", "(SELECT * FROM store_master WHERE store_size_sqft > 0) s", "store_id"),
                                             _match("sku_master", "sku_master", "sku_id"), _match("calendar", "calendar", "date")]))
def q21(t):
    dims = {"sized_stores": (t.store_master.where("store_size_sqft > 0"), "store_id"), "sku_master": (t.sku_master, "sku_id"), "calendar": (t.calendar, "date")}
    return quality.match_rate(t.daily_units, dims, "sales_daily")


@query("q22_batch_quality", f"""
SELECT 'n_rows' AS "check", CAST(count(*) AS DOUBLE) AS value FROM forecast_base
UNION ALL SELECT 'negative_average_unit_price', CAST(count_if(average_unit_price < 0) AS DOUBLE) FROM forecast_base
UNION ALL SELECT 'null_pct_date', {r('avg(CASE WHEN date IS NULL THEN 1 ELSE 0 END) * 100', 4)} FROM forecast_base
UNION ALL SELECT 'null_pct_promotion_flag', {r('avg(CASE WHEN promotion_flag IS NULL THEN 1 ELSE 0 END) * 100', 4)} FROM forecast_base
UNION ALL SELECT 'n_duplicates', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT source_dataset, product_key, date FROM forecast_base) d) AS DOUBLE) FROM forecast_base
UNION ALL SELECT 'missing_required_columns', CAST(1 AS DOUBLE) UNION ALL SELECT 'leakage_columns_present', CAST(3 AS DOUBLE)""")
def q22(t):
    return quality.batch_quality(t.forecast_base, ["date", "promotion_flag", "prediction"], ["source_dataset", "product_key", "date"], ["units_sold_lag_1", "average_unit_price"],
                                 quality.LEAKAGE_FIELDS)


def _unseen(c):
    new = f"{c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM store_master WHERE store_size_sqft > 20000 AND {c} IS NOT NULL)"
    return f"""SELECT '{c}' AS "column", count(DISTINCT CASE WHEN {new} THEN {c} END) AS n_unseen_levels, {pct(f'count_if({new})', 'count(*)')} AS unseen_rate_pct FROM store_master"""


@query("q22_unseen_categories", " UNION ALL ".join(_unseen(c) for c in ("city", "region", "store_name")))
def q22b(t):
    return quality.unseen_categories(t.store_master, t.store_master.where("store_size_sqft > 20000"), ["city", "region", "store_name"])


@query("q22_date_gaps", f"""
SELECT {ci('n >= 2')} AS series_checked, {big('sum(g)')} AS gaps_gt_1_day FROM (SELECT source_dataset, entity_id, product_key, count(*) AS n, count_if(gap > 1) AS g FROM (
 SELECT *, date - lag(date) OVER (PARTITION BY source_dataset, entity_id, product_key ORDER BY date) AS gap FROM (SELECT DISTINCT source_dataset, entity_id, product_key, date FROM fact_sales) d) x
 GROUP BY 1, 2, 3) y""")
def q22c(t):
    return quality.date_gaps(t.fact_sales, features.GRAIN)


@query("q23_weekly_quality", f"""
WITH a AS (SELECT count(*) AS rows, {ci("source_dataset <> 'SYNTHETIC'")} AS unexpected_rows, {ci('week IS NULL')} AS invalid_date_rows, {ci('units_sold < 0')} AS negative_rows, count(DISTINCT product_key) AS sku_count,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT week, product_key FROM weekly_sku) d) AS duplicate_count FROM weekly_sku),
 w AS (SELECT week, count(*) AS n FROM weekly_sku GROUP BY 1), s AS (SELECT arg_max(n, week) AS latest_week_rows, quantile_cont(n, 0.5) AS med FROM w),
 c AS (SELECT a.*, latest_week_rows, {big('floor(med)')} AS median_weekly_rows, 'PASS' AS schema_validity, CASE WHEN unexpected_rows > 0 THEN 'FAIL' ELSE 'PASS' END AS unexpected_source, 'PASS' AS missing_values,
  CASE WHEN duplicate_count > 0 THEN 'FAIL' ELSE 'PASS' END AS duplicate_records, CASE WHEN invalid_date_rows > 0 THEN 'FAIL' ELSE 'PASS' END AS invalid_dates,
  CASE WHEN negative_rows > 0 THEN 'FAIL' ELSE 'PASS' END AS negative_quantities, CASE WHEN sku_count < 90 THEN 'WARNING' ELSE 'PASS' END AS sku_coverage,
  CASE WHEN abs(latest_week_rows - med) / greatest(med, 1) > 0.2 THEN 'WARNING' ELSE 'PASS' END AS row_count_anomaly FROM a, s)
SELECT *, CASE WHEN 'FAIL' IN (unexpected_source, duplicate_records, invalid_dates, negative_quantities) THEN 'FAIL' WHEN 'WARNING' IN (sku_coverage, row_count_anomaly) THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM c""")
def q23(t):
    return quality.weekly_quality(star.weekly_sku(t.sales_daily))


CONTRACT = ["lag_1", "lag_52", "rolling_mean_4", "rolling_std_4", "price_lag1", "week_of_year"]
_WK = "PARTITION BY source_dataset, product_key ORDER BY week"


def _feat(c):
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS feature, {r(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', 4)} AS null_rate, {r(f'avg({v})', 4)} AS mean, {r(f'stddev_samp({v})', 4)} AS std,
 {r(f'min({v})', 4)} AS min, {r(f'max({v})', 4)} AS max FROM latest"""


@query("q24_feature_contract", f"""
WITH f AS (SELECT week, lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 52) OVER w AS lag_52, avg(units_sold) OVER ({_WK} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
  COALESCE(stddev_samp(units_sold) OVER ({_WK} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_4, lag(avg_unit_price, 1) OVER w AS price_lag1, weekofyear(week) AS week_of_year
  FROM weekly_demand WINDOW w AS ({_WK})), latest AS (SELECT * FROM f WHERE week = (SELECT max(week) FROM f))
SELECT *, CASE WHEN null_rate > 0.1 THEN 'FAIL' WHEN null_rate > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM ({' UNION ALL '.join(_feat(c) for c in CONTRACT)}) u
UNION ALL SELECT 'undelivered_feature', NULL, NULL, NULL, NULL, NULL, 'FAIL'""")
def q24(t):
    return quality.feature_contract(features.weekly_features(t.weekly_demand), [*CONTRACT, "undelivered_feature"])


FEATS = ["units_sold_lag_1", "units_sold_lag_7", "rolling_mean_7", "rolling_std_7"]
_D = "PARTITION BY source_dataset, entity_id, product_key ORDER BY date"


def _frep(c):
    return f"""SELECT '{c}' AS feature, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct, count(*) - count({c}) AS missing_count, {big('0')} AS infinite_count,
 count(DISTINCT {c}) AS distinct_count, {r(f'min({c})', 6)} AS min_value, {r(f'max({c})', 6)} AS max_value FROM f"""


FEATURE_CTE = f"""f AS (SELECT source_dataset, entity_id, product_key, date, lag(units_sold, 1) OVER w AS units_sold_lag_1, lag(units_sold, 7) OVER w AS units_sold_lag_7,
 {r(f'avg(units_sold) OVER ({_D} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_mean_7, {r(f'stddev_samp(units_sold) OVER ({_D} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_std_7
 FROM fact_sales WINDOW w AS ({_D}))"""


@query("q25_feature_report", f"WITH {FEATURE_CTE} {' UNION ALL '.join(_frep(c) for c in FEATS)}")
def q25(t):
    return quality.feature_report(_daily(t).withColumns({c: rnd(c, 6) for c in FEATS[2:]}), FEATS)


def _daily(t):
    return t.fact_sales.withColumns({
        **features.lags(features.GRAIN, "units_sold", DAILY_LAGS, "date", "units_sold_lag_"),
        **features.rolling(features.GRAIN, "units_sold", DAILY_WINDOWS, "date", ("mean", "std"))})


CHECKS = ["first_row_has_history", *[f"lag_{k}_mismatch" for k in DAILY_LAGS], *[f"rolling_mean_{w}_mismatch" for w in DAILY_WINDOWS]]


@query("q27_leakage_checks", " UNION ALL ".join(f"SELECT '{c}' AS \"check\", (SELECT count(*) FROM fact_sales) AS rows_checked, {big('0')} AS violations" for c in CHECKS))
def q27(t):
    return quality.leakage_checks(_daily(t), features.GRAIN, DAILY_LAGS, DAILY_WINDOWS)


POS = "SELECT *, row_number() OVER (PARTITION BY source_dataset, entity_id, product_key ORDER BY date) AS pos FROM fact_sales"


@query("q27_planted_leaks", f"SELECT 'first_row_has_history' AS \"check\", (SELECT count(*) FROM fact_sales) AS rows_checked, (SELECT {ci('day(date) = 1 AND pos = 1')} FROM ({POS}) x) AS violations UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', (SELECT count(*) FROM fact_sales), (SELECT {ci(f'day(date) = {n + 1}')} FROM fact_sales)" for n, c in enumerate(CHECKS[1:])))
def q27_planted(t):
    """The same checks with a wrong value planted in each column on another day of the month: every rule finds its own."""
    planted = [*[f"units_sold_lag_{k}" for k in DAILY_LAGS], *[f"rolling_mean_{w}" for w in DAILY_WINDOWS]]
    rows = _daily(t).withColumns({c: F.when(F.day("date") == n + 1, F.lit(-999.5)).otherwise(F.col(c).cast("double")) for n, c in enumerate(planted)})
    return quality.leakage_checks(rows, features.GRAIN, DAILY_LAGS, DAILY_WINDOWS)


@query("q27_split_order", """
SELECT source_dataset, train_end, val_start, val_end, test_start, train_end < val_start AND val_end < test_start AS ordered FROM (
 SELECT source_dataset, max(CASE WHEN split = 'train' THEN date END) AS train_end, min(CASE WHEN split = 'validation' THEN date END) AS val_start,
  max(CASE WHEN split = 'validation' THEN date END) AS val_end, min(CASE WHEN split = 'test' THEN date END) AS test_start FROM panel GROUP BY 1) t""")
def q27b(t):
    return quality.split_order(t.panel)


def _viol(name, cond):
    return f"SELECT count(*) AS rows, '{name}' AS \"check\", {ci(cond)} AS violations FROM f"


@query("q28_inference_contract", f"""
WITH f AS (SELECT *, lag(units_sold, 1) OVER (PARTITION BY source_dataset, entity_id, product_key ORDER BY date) AS units_sold_lag_1, 1 AS horizon,
  lead(date, 3) OVER (PARTITION BY source_dataset, entity_id, product_key ORDER BY date) AS hcal_target FROM fact_sales)
{_viol('wrong_source', "source_dataset <> 'SYNTHETIC'")} UNION ALL {_viol('wrong_horizon', 'horizon <> 1')} UNION ALL {_viol('missing_lag_1', 'units_sold_lag_1 IS NULL')}
UNION ALL {_viol('non_numeric_product_key', 'TRY_CAST(product_key AS DOUBLE) IS NULL')} UNION ALL {_viol('negative_average_unit_price', 'average_unit_price < 0')}
UNION ALL {_viol('missing_hcal_target', 'hcal_target IS NULL')}
UNION ALL SELECT count(*), 'duplicate_keys', count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, source_dataset, entity_id, product_key FROM f) d) FROM f""")
def q28(t):
    w = features.series(features.GRAIN)
    batch = t.fact_sales.withColumns({"units_sold_lag_1": F.lag("units_sold", 1).over(w), "horizon": F.lit(1), "hcal_target": F.lead("date", 3).over(w)})
    return quality.inference_contract(batch, "SYNTHETIC", 1, ["product_key"], ["average_unit_price"])


@query("q29_record_validation", f"""
WITH rec AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, concat('user_', CAST(user_id AS VARCHAR)) AS entity_id, event_type AS product_key, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
 c AS (SELECT *, count(*) OVER (PARTITION BY entity_id, product_key, date) AS copies FROM rec)
SELECT COALESCE(reason, 'valid') AS reason, count(*) AS n FROM (SELECT CASE WHEN event_type_bad THEN 'forbidden_field' WHEN leak THEN 'leakage_column' WHEN inf THEN 'non_finite_value' WHEN neg THEN 'negative_value'
  WHEN miss THEN 'missing_lag_1' WHEN copies > 1 THEN 'duplicate_key' END AS reason
 FROM (SELECT copies, product_key = 'error' AND k > 90 AS event_type_bad, product_key = 'signup' AND k > 90 AS leak, k = 7 AS inf, k = 8 AS neg, k = 9 OR k IS NULL AS miss FROM c) x) y GROUP BY 1""")
def q29(t):
    k = F.from_json("props", "k int")["k"]
    key = F.when((F.col("event_type") == "error") & (k > 90), "model_path").when((F.col("event_type") == "signup") & (k > 90), "revenue").otherwise("note")
    lag = F.when(k == 7, "NaN").when(k == 8, "-1").when(k.isNotNull() & (k != 9), F.col("value").cast("string"))
    records = t.table("events").select(
        F.col("ts").cast("date").alias("date"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("product_key"),
        F.create_map(key, F.lit("1"), F.lit("units_sold_lag_1"), lag).alias("features"))
    checked = quality.validate_records(records, ["entity_id", "product_key", "date"])
    return checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("q30_frame_difference", f"""
WITH a AS (SELECT product_key, week, units_sold, revenue FROM weekly_sku), b AS (SELECT product_key, week, units_sold + CASE WHEN promotion_flag = 0 THEN 1 ELSE 0 END AS units_sold, revenue FROM weekly_sku WHERE store_count > 3)
SELECT *, only_left + only_right + differs_units_sold + differs_revenue = 0 AS equal FROM (
 SELECT {ci('a.week IS NOT NULL AND b.week IS NOT NULL')} AS matched_rows, {ci('b.week IS NULL')} AS only_left, {ci('a.week IS NULL')} AS only_right,
  {ci('a.units_sold <> b.units_sold')} AS differs_units_sold, {big('0')} AS differs_revenue FROM a FULL JOIN b ON a.product_key = b.product_key AND a.week = b.week) t""")
def q30(t):
    a = star.weekly_sku(t.sales_daily)
    b = a.where("store_count > 3").withColumn("units_sold", F.col("units_sold") + F.when(F.col("promotion_flag") == 0, 1).otherwise(0))
    return quality.frame_difference(a, b, ["product_key", "week"], ["units_sold", "revenue"])
