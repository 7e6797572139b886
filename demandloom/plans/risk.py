"""Risk, reporting-extract and forecast roll-up queries."""

from uuid import uuid4

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.functions.vocabulary import REVIEWS
from demandloom.operators import bi, metrics, risk
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, ci, r
from demandloom.plans.views import scored
from demandloom.session import shared_dir, stored
from demandloom.streaming import requests

R1 = ["store_id", "sku_id", "ending_inventory", "on_order_qty", "total_recent_units", "lead_time_days", "reorder_point", "safety_stock", "stockout_risk_score", "stockout_risk_level",
      "overstock_risk_score", "overstock_risk_level", "excess_units", "reorder_triggered", "rop_position_triggered", "recommended_reorder_qty", "replenishment_note"]
R1F = ["avg_daily_demand", "std_daily_demand", "total_recent_revenue", "days_of_supply", "capital_tied_up", "annual_holding_cost", "recommended_order_spend", "potential_lost_daily_revenue"]


@query("r1_risk_matrix", f"SELECT {', '.join(R1)}, {', '.join(f'{r(c, 4)} AS {c}' for c in R1F)} FROM risk_matrix")
def r1(t):
    return t.risk_matrix.select(*R1, *[rnd(c, 4).alias(c) for c in R1F])


POS = "sku_position"


@query("r2_forecast_risk", f"""
SELECT sku_id, on_hand_units, on_order_units, {r('demand', 4)} AS forecast_weekly_demand, lead AS lead_time_weeks, {r('lead_time_demand', 4)} AS lead_time_demand, inventory_position, {r('wos', 4)} AS weeks_of_supply,
 stockout_risk_score, stockout_risk_level, overstock_risk_score, overstock_risk_level, CAST(trunc(excess) AS BIGINT) AS excess_units, {r('CAST(trunc(excess) AS BIGINT) * cost_price', 4)} AS locked_capital,
 {r("CASE WHEN stockout_risk_level IN ('CRITICAL', 'MEDIUM') THEN lead_time_demand * base_price ELSE 0 END", 4)} AS sales_at_risk, recommended_action FROM ({scored(POS, 8)}) t""")
def r2(t):
    made = risk.forecast_risk(t.sku_forecast, t.weekly_inventory, t.sku_master)
    rounded = ["forecast_weekly_demand", "lead_time_demand", "weeks_of_supply", "locked_capital", "sales_at_risk"]
    return made.select("sku_id", "on_hand_units", "on_order_units", "lead_time_weeks", "inventory_position", "stockout_risk_score", "stockout_risk_level", "overstock_risk_score",
                       "overstock_risk_level", "excess_units", "recommended_action", *[rnd(c, 4).alias(c) for c in rounded])


@query("r2_recent_demand_fallback", f"""
SELECT product_key, {r('avg(units_sold)', 4)} AS forecast_weekly_demand FROM weekly_demand WHERE week >= (SELECT max(week) - 56 FROM weekly_demand) GROUP BY 1""")
def r2b(t):
    return risk.recent_actual_demand(t.weekly_demand).withColumn("forecast_weekly_demand", rnd("forecast_weekly_demand", 4))


@query("r3_portfolio", "SELECT * FROM sku_risk")
def r3(t):
    return t.sku_risk


@query("r4_explanations", """
SELECT sku_id, forecast_weekly_demand AS forecast_demand, lead_time_demand, on_hand_units AS on_hand, safety_stock AS safety_threshold, projected_balance, stockout_risk_level AS stockout_risk, recommended_action, sales_at_risk, locked_capital,
 CAST(10 AS BIGINT) AS json_fields FROM sku_risk""")
def r4(t):
    e = risk.explain(t.sku_risk)
    keys = F.size(F.json_object_keys("explanation")).cast("long").alias("json_fields")
    return e.select("sku_id", "payload.forecast_demand", "payload.lead_time_demand", "payload.on_hand", "payload.safety_threshold", "payload.projected_balance", "payload.stockout_risk",
                    "payload.recommended_action", "payload.financial_impact.sales_at_risk", "payload.financial_impact.locked_capital", keys)


def _lv(c, v, n):
    return f"{ci(f'{c} = {chr(39)}{v}{chr(39)}')} AS {n}"


@query("r5_risk_summary", f"""
SELECT count(*) AS total_skus, {_lv('stockout_risk_level', 'CRITICAL', 'stockout_critical')}, {_lv('stockout_risk_level', 'MEDIUM', 'stockout_medium')}, {_lv('stockout_risk_level', 'LOW', 'stockout_low')},
 {_lv('overstock_risk_level', 'SEVERE', 'overstock_severe')}, {_lv('overstock_risk_level', 'MODERATE', 'overstock_moderate')}, {_lv('overstock_risk_level', 'OPTIMAL', 'overstock_optimal')},
 {_lv('recommended_action', 'REORDER NOW', 'reorder_now')}, {_lv('recommended_action', 'MARKDOWN / CLEAR', 'markdown_clear')}, {_lv('recommended_action', 'WATCH / VOLATILE', 'watch_volatile')}, {_lv('recommended_action', 'HEALTHY', 'healthy')},
 {r('sum(locked_capital)', 2)} AS total_locked_capital, {r('sum(sales_at_risk)', 2)} AS total_sales_at_risk FROM sku_risk""")
def r5(t):
    return risk.summary(t.sku_risk)


STRESS = """(SELECT p.sku_id, s.scenario, s.expected_action, greatest(demand, 1) AS demand, 2 AS lead, greatest(demand, 1) * CAST(factor AS DOUBLE) AS on_hand_units, greatest(demand, 1) * CAST(ordered AS DOUBLE) AS on_order_units,
 greatest(demand, 1) * CAST(0.5 AS DOUBLE) AS safety_stock, greatest(demand, 1) * 2 AS reorder_point FROM sku_position p,
 (VALUES ('severe_stockout', 'REORDER NOW', 0.0, 0), ('moderate_stockout', 'WATCH / VOLATILE', 1, 0), ('healthy_inventory', 'HEALTHY', 4, 0), ('moderate_overstock', 'WATCH / VOLATILE', 9, 0), ('severe_overstock', 'MARKDOWN / CLEAR', 17, 0), ('high_volatility', 'REORDER NOW', 0.01, 4)) s(scenario, expected_action, factor, ordered)) x"""


@query("r6_stress_scenarios", f"SELECT sku_id, scenario, stockout_risk_level, overstock_risk_level, recommended_action, recommended_action = expected_action AS pass FROM ({scored(STRESS, 8)}) t")
def r6(t):
    made = risk.stress(risk.portfolio_input(t.sku_forecast, t.weekly_inventory, t.sku_master))
    return made.select("sku_id", "scenario", "stockout_risk_level", "overstock_risk_level", "recommended_action", "pass")


@query("r7_consistency", f"""
WITH c AS (SELECT count(*) AS total_skus, {ci('abs(weeks_of_supply - on_hand_units / greatest(forecast_weekly_demand, CAST(0.01 AS DOUBLE))) > 0.1 + 0.05 * abs(on_hand_units / greatest(forecast_weekly_demand, CAST(0.01 AS DOUBLE)))')} AS weeks_of_supply_mismatch,
 {ci("recommended_action = 'REORDER NOW' AND stockout_risk_level <> 'CRITICAL'")} AS reorder_without_critical, {ci("recommended_action = 'MARKDOWN / CLEAR' AND overstock_risk_level <> 'SEVERE'")} AS markdown_without_severe,
 {ci("recommended_action = 'HEALTHY' AND stockout_risk_level <> 'LOW'")} AS healthy_elevated_stockout, {ci("recommended_action = 'HEALTHY' AND overstock_risk_level <> 'OPTIMAL'")} AS healthy_elevated_overstock,
 {ci("recommended_action = 'HEALTHY' AND projected_balance < -100")} AS healthy_negative_balance, {ci('sales_at_risk < 0 OR locked_capital < 0')} AS negative_exposure,
 {r("count_if(recommended_action = 'REORDER NOW') / CAST(count(*) AS DOUBLE) * 100", 2)} AS reorder_pct FROM sku_risk)
SELECT *, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS consistency_status, CASE WHEN reorder_pct > 80 THEN 'WARNING' ELSE 'PASS' END AS distribution_status,
 CASE WHEN bad > 0 THEN 'FAIL' WHEN reorder_pct > 80 THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM (SELECT *, weeks_of_supply_mismatch + reorder_without_critical + markdown_without_severe + healthy_elevated_stockout
 + healthy_elevated_overstock + healthy_negative_balance + negative_exposure AS bad FROM c) d""".replace("SELECT *, CASE WHEN bad", "SELECT * EXCLUDE (bad), CASE WHEN bad"))
def r7(t):
    return risk.consistency(t.sku_risk)


@query("r8_attach_position", f"""
SELECT source_dataset, f.entity_id, f.product_key, inventory_date, ending_inventory, CASE WHEN ending_inventory IS NULL THEN 'NOT AVAILABLE' ELSE 'AVAILABLE' END AS inventory_status, count(*) AS forecasts, {r('sum(prediction)', 4)} AS predicted
FROM forecast_rows f LEFT JOIN (SELECT store_id AS entity_id, concat('SYN_', sku_id) AS product_key, arg_max(ending_inventory, date) AS ending_inventory, max(date) AS inventory_date FROM inventory_snapshots GROUP BY 1, 2) i
 ON f.entity_id = i.entity_id AND f.product_key = i.product_key WHERE horizon = 1 GROUP BY 1, 2, 3, 4, 5, 6""")
def r8(t):
    made = risk.attach_position(t.forecasts_at([1]), t.inventory_snapshots)
    return made.groupBy("source_dataset", "entity_id", "product_key", "inventory_date", "ending_inventory", "inventory_status").agg(
        F.count("*").alias("forecasts"), rnd(F.sum("prediction"), 4).alias("predicted"))


def _pick(name, keep, order):
    return f"(SELECT '{name}' AS scenario, store_id, sku_id, stockout_risk_level, overstock_risk_level, {r('days_of_supply', 4)} AS days_of_supply, ending_inventory FROM risk_matrix WHERE {keep} ORDER BY {order}, store_id, sku_id LIMIT 1)"


@query("r9_representative_rows", " UNION ALL ".join([
    _pick("HIGH_STOCKOUT_RISK", "stockout_risk_level = 'CRITICAL / HIGH'", "-stockout_risk_score"),
    _pick("OVERSTOCK", "overstock_risk_level <> 'OPTIMAL'", "CASE WHEN overstock_risk_level = 'SEVERE OVERSTOCK' THEN 0 ELSE 1 END, -overstock_risk_score"),
    _pick("STABLE", "stockout_risk_level = 'LOW / SAFE' AND overstock_risk_level = 'OPTIMAL'", "days_of_supply")]))
def r9(t):
    return risk.representative_rows(t.risk_matrix).withColumn("days_of_supply", rnd("days_of_supply", 4))


@query("r10_matrix_contract", f"""
SELECT count(*) AS rows, {ci("stockout_risk_level = 'CRITICAL / HIGH'")} AS critical_rows, {ci("overstock_risk_level = 'SEVERE OVERSTOCK'")} AS severe_rows, {ci('reorder_triggered')} AS reorder_rows, count(DISTINCT store_id) AS stores, count(DISTINCT sku_id) AS skus,
 15 AS required_columns, '' AS missing_columns, count(*) > 0 AS available FROM risk_matrix""")
def r10(t):
    return risk.matrix_contract(t.risk_matrix)


# ---- reporting extracts ------------------------------------------------------------
@query("i1_executive_row", f"""
WITH s AS (SELECT count(*) AS n_rows, {ci("stockout_risk_level = 'CRITICAL / HIGH'")} AS stockout_critical_high, {ci("overstock_risk_level = 'SEVERE OVERSTOCK'")} AS overstock_severe, {ci("overstock_risk_level = 'MODERATE OVERSTOCK'")} AS overstock_moderate,
 {ci('reorder_triggered')} AS reorder_review_count, {ci("stockout_risk_level = 'LOW / SAFE' AND overstock_risk_level = 'OPTIMAL'")} AS no_exceptional_risk, {r('avg(days_of_supply)', 4)} AS mean_days_of_supply,
 {big('COALESCE(sum(total_recent_units), 0)')} AS total_recent_units, {r('avg(avg_daily_demand)', 4)} AS avg_daily_demand, {r('avg(std_daily_demand) / greatest(avg(avg_daily_demand), 1e-9)', 4)} AS demand_volatility_cv, count(DISTINCT sku_id) AS n_products FROM risk_matrix),
 f AS (SELECT {r('avg(abs(actual - prediction))', 4)} AS mae, {r('sqrt(avg((actual - prediction) * (actual - prediction)))', 4)} AS rmse, {r('sum(abs(actual - prediction)) / sum(abs(actual)) * 100', 4)} AS wape, {r('avg(prediction - actual)', 4)} AS bias FROM forecast_rows),
 q AS (SELECT count(*) AS request_count, {r("count_if(event_type = 'error') / CAST(count(*) AS DOUBLE)", 4)} AS error_rate, CAST(avg(value) AS DOUBLE) AS mean_latency FROM events)
SELECT s.*, f.*, request_count, error_rate, round(mean_latency, 3) AS mean_latency_ms, 'Insufficient Evidence' AS growth_on_extract FROM s, f, q""")
def i1(t):
    rows = t.forecast_rows.withColumn("_all", F.lit(1))
    acc = rows.groupBy("_all").agg(*metrics.accuracy_columns("actual", "prediction"), *metrics.extended_columns("actual", "prediction"))
    out = bi.executive_row(t.risk_matrix, acc, requests.totals(t.table("events")))
    return out.withColumn("mean_latency_ms", F.expr("round(try_cast(mean_latency_ms AS DOUBLE), 3)"))


DAILY = "SELECT source_dataset, horizon, forecast_date, avg(actual) AS actual, avg(prediction) AS forecast, avg(lower_bound) AS p10, avg(upper_bound) AS p90, count(*) AS n FROM forecast_rows GROUP BY 1, 2, 3"


@query("i2_daily_performance", f"""
SELECT source_dataset, horizon, forecast_date, n, {', '.join(f'{r(c, 6)} AS {c}' for c in ('actual', 'forecast', 'p10', 'p90'))}, {r('forecast - actual', 6)} AS error, {r('abs(forecast - actual)', 6)} AS absolute_error FROM ({DAILY}) t""")
def i2(t):
    d = bi.daily_performance(t.forecast_rows)
    return d.withColumns({c: rnd(c, 6) for c in ("actual", "forecast", "p10", "p90", "error", "absolute_error")})


@query("i3_seasonality", f"""
WITH d AS ({DAILY}), m AS (SELECT source_dataset, horizon, CAST(month(forecast_date) AS INTEGER) AS period, avg(actual) AS mean_actual, {big('sum(n)')} AS n, 'monthly' AS pattern FROM d GROUP BY 1, 2, 3),
 w AS (SELECT source_dataset, horizon, CAST(isodow(forecast_date) - 1 AS INTEGER) AS period, avg(actual) AS mean_actual, {big('sum(n)')} AS n, 'weekly' AS pattern FROM d GROUP BY 1, 2, 3)
SELECT source_dataset, horizon, period, {r('mean_actual', 6)} AS mean_actual, n, pattern, CAST(NULL AS DOUBLE) AS seasonality_cv, CAST(NULL AS BOOLEAN) AS weak_or_uncertain, CAST(NULL AS INTEGER) AS seasonal_peak_month, CAST(NULL AS INTEGER) AS seasonal_low_month
FROM (SELECT * FROM m UNION ALL SELECT * FROM w) u UNION ALL
SELECT source_dataset, NULL, NULL, {r('avg(mean_actual)', 6)}, {big('sum(n)')}, 'monthly_summary', {r('stddev_pop(mean_actual) / NULLIF(avg(mean_actual), 0)', 4)}, stddev_pop(mean_actual) / NULLIF(avg(mean_actual), 0) < 0.10,
 arg_max(period, (mean_actual, -horizon, -period)), arg_min(period, (mean_actual, horizon, period)) FROM m GROUP BY 1""")
def i3(t):
    return bi.seasonality(bi.daily_performance(t.forecast_rows)).withColumn("mean_actual", rnd("mean_actual", 6))


GROWTH = """
SELECT source_dataset, entity_id, product_key, historical_demand, n_hist, forecast, p10, p90, recent_demand, n_recent, (recent_demand - historical_demand) / greatest(abs(historical_demand), 1e-9) AS growth_rate,
 abs(p90 - p10) / greatest(abs(forecast), 1e-9) AS relative_interval_width,
 CASE WHEN recent_demand IS NULL OR historical_demand IS NULL OR n_hist < 10 OR n_recent < 10 THEN 'Insufficient Evidence'
  WHEN abs((recent_demand - historical_demand) / greatest(abs(historical_demand), 1e-9)) < 0.05 THEN 'Stable' WHEN recent_demand > historical_demand THEN 'Growing' ELSE 'Declining' END AS growth_class
FROM (SELECT h.source_dataset, h.entity_id, h.product_key, avg(CASE WHEN d <= mid THEN actual END) AS historical_demand, NULLIF(count_if(d <= mid), 0) AS n_hist, avg(CASE WHEN d <= mid THEN prediction END) AS forecast,
  avg(CASE WHEN d <= mid THEN lower_bound END) AS p10, avg(CASE WHEN d <= mid THEN upper_bound END) AS p90, avg(CASE WHEN d > mid THEN actual END) AS recent_demand, NULLIF(count_if(d > mid), 0) AS n_recent
 FROM (SELECT *, forecast_date - DATE '1970-01-01' AS d FROM forecast_rows WHERE horizon = 1) h
 JOIN (SELECT source_dataset, entity_id, product_key, quantile_cont(forecast_date - DATE '1970-01-01', 0.5) AS mid FROM forecast_rows WHERE horizon = 1 GROUP BY 1, 2, 3) m
  ON h.source_dataset = m.source_dataset AND h.entity_id = m.entity_id AND h.product_key = m.product_key GROUP BY 1, 2, 3) t"""
GF = ["historical_demand", "forecast", "p10", "p90", "recent_demand", "growth_rate", "relative_interval_width"]


@query("i4_product_growth", f"SELECT source_dataset, entity_id, product_key, {big('n_hist')} AS n_hist, {big('n_recent')} AS n_recent, growth_class, {', '.join(f'{r(c, 6)} AS {c}' for c in GF)} FROM ({GROWTH}) g")
def i4(t):
    return bi.product_growth(t.forecast_rows).withColumns({c: rnd(c, 6) for c in GF})


VIEW = f"""v AS (SELECT m.*, g.growth_class AS gc, g.growth_rate, g.relative_interval_width, avg_daily_demand > (SELECT quantile_cont(avg_daily_demand, 0.5) FROM risk_matrix) AS dh, ending_inventory > (SELECT quantile_cont(CAST(ending_inventory AS DOUBLE), 0.5) FROM risk_matrix) AS ih,
 rank() OVER (ORDER BY total_recent_revenue DESC NULLS LAST) AS hi, rank() OVER (ORDER BY total_recent_revenue NULLS LAST) AS lo FROM risk_matrix m
 LEFT JOIN ({GROWTH}) g ON g.source_dataset = 'SYNTHETIC' AND g.entity_id = m.store_id AND g.product_key = concat('SYN_', m.sku_id)),
x AS (SELECT *, COALESCE(gc, 'Insufficient Evidence') AS growth_class, CASE WHEN dh AND ih THEN 'Critical Review' WHEN dh THEN 'Stockout Review' WHEN ih THEN 'Overstock Review' ELSE 'Normal' END AS risk_matrix_cell,
 CASE WHEN total_recent_revenue IS NULL THEN 'MID' WHEN hi <= 10 THEN 'TOP_REVENUE' WHEN lo <= 10 THEN 'LOW DEMAND' ELSE 'MID' END AS demand_rank_label FROM v)"""


@query("i5_inventory_view", f"""
WITH {VIEW} SELECT store_id, sku_id, risk_matrix_cell, demand_rank_label, growth_class, {r('total_recent_units / greatest(CAST((SELECT sum(total_recent_units) FROM risk_matrix) AS DOUBLE), 1e-9)', 6)} AS demand_share,
 {r('growth_rate', 6)} AS growth_rate, {r('relative_interval_width', 6)} AS relative_interval_width FROM x""")
def i5(t):
    v = bi.inventory_view(t.risk_matrix, bi.product_growth(t.forecast_rows))
    return v.select("store_id", "sku_id", "risk_matrix_cell", "demand_rank_label", "growth_class", *[rnd(c, 6).alias(c) for c in ("demand_share", "growth_rate", "relative_interval_width")])


_RULES = (
    ("stockout", "stockout_risk_level = 'CRITICAL / HIGH'", "concat('stockout_risk_level=', stockout_risk_level, '; ending_inventory=', CAST(ending_inventory AS VARCHAR))"),
    ("overstock", "overstock_risk_level <> 'OPTIMAL'", "concat('overstock_risk_level=', overstock_risk_level, '; days_of_supply=', COALESCE(printf('%.4f', CAST(days_of_supply AS DOUBLE)), 'NOT AVAILABLE'))"),
    ("reorder", "reorder_triggered", "concat('reorder_triggered=True; reorder_point=', CAST(reorder_point AS VARCHAR))"),
    ("uncertainty", "relative_interval_width >= 0.5", "concat('relative_interval_width=', printf('%.4f', relative_interval_width), '; threshold=0.5')"),
    ("growth", "growth_class = 'Growing'", "concat('growth_class=Growing; growth_rate=', COALESCE(printf('%.4f', growth_rate), 'NOT AVAILABLE'))"),
    ("matrix", "risk_matrix_cell = 'Critical Review'", "concat('risk_matrix_cell=', risk_matrix_cell)"),
    ("none", "TRUE", "concat('stockout=', stockout_risk_level, '; overstock=', overstock_risk_level, '; cell=', risk_matrix_cell)"),
)


def _case(of):
    return "CASE " + " ".join(f"WHEN {holds} THEN {of(name, evidence)}" for name, holds, evidence in _RULES) + " END"


def _word(k):
    return lambda name, _: "replace('{}', '{{}}', overstock_risk_level)".format(REVIEWS[name][k])


@query("i6_recommendations", f"""
WITH {VIEW} SELECT store_id, sku_id, {_case(lambda name, _: REVIEWS[name][0])} AS priority, {_case(_word(1))} AS recommended_review, {_case(_word(2))} AS reason,
 {_case(lambda _, evidence: evidence)} AS evidence, {_case(_word(3))} AS confidence_limitation, FALSE AS autonomous_decision FROM x""")
def i6(t):
    return bi.recommendations(bi.inventory_view(t.risk_matrix, bi.product_growth(t.forecast_rows)))


def _health(t, forecasts, risk_rows):
    return bi.health_row(t.daily_units, forecasts, t.table("events"), risk_rows.where("stockout_risk_level = 'CRITICAL / HIGH'"))


def _bundled(t, tables):
    """Tables of a bundle, written under one version and read again, with its manifest row."""
    folder = f"{shared_dir(t.spark)}/bundles/{uuid4().hex}"
    return bi.read_bundle(t.spark, folder, bi.write_bundle(tables, folder))


SIZES = {
    "executive_kpis": "1", "product_demand": "(SELECT count(*) FROM risk_matrix)", "forecast_performance": f"(SELECT count(*) FROM ({DAILY}) d)", "inventory_risk": "(SELECT count(*) FROM risk_matrix)",
    "recommendations": "(SELECT count(*) FROM risk_matrix)", "system_health": "1",
    "seasonality": f"(SELECT count(DISTINCT (source_dataset, horizon, month(forecast_date))) + count(DISTINCT (source_dataset, horizon, isodow(forecast_date))) + count(DISTINCT source_dataset) FROM ({DAILY}) d)",
}


@query("i7_schema_issues", " UNION ALL ".join(f"SELECT '{name}' AS extract, '' AS missing_columns, {big(n)} AS rows, {n} = 0 AS is_empty, {n} > 0 AS ok" for name, n in SIZES.items()))
def i7(t):
    """Every extract of a committed bundle, checked on its written files."""
    forecasts, risk_rows = stored(t.forecast_rows, "forecasts"), stored(t.risk_matrix, "risk")
    accuracy = forecasts.withColumn("_all", F.lit(1)).groupBy("_all").agg(*metrics.accuracy_columns("actual", "prediction"), *metrics.extended_columns("actual", "prediction"))
    made = bi.extracts(risk_rows, accuracy, requests.totals(t.table("events")), forecasts, _health(t, forecasts, risk_rows))
    row, found = _bundled(t, made)
    return bi.schema_issues(found, {name: df.columns for name, df in made.items()}, {x.extract: x.rows for x in row.extracts}).drop("required")


@query("i7_system_health", f"""
SELECT (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) AS data_as_of, (SELECT count(*) FROM sales_daily) AS n_sales_rows, (SELECT max(origin_date) FROM forecast_rows) AS forecast_generated, (SELECT count(*) FROM forecast_rows) AS n_forecast_rows,
 CAST(0 AS BIGINT) AS n_missing_predictions, (SELECT max(ts) FROM events) AS monitoring_snapshot, (SELECT count(*) FROM risk_matrix WHERE stockout_risk_level = 'CRITICAL / HIGH') AS n_alerts, FALSE AS live_data, 'disabled' AS retraining""")
def i7_health(t):
    return _bundled(t, {"system_health": _health(t, t.forecast_rows, t.risk_matrix)})[1]["system_health"]


@query("i10_forecast_rollups", f"""
SELECT source_dataset, horizon, product_key, count(*) AS n, {r('avg(actual)', 4)} AS mean_actual, {r('avg(prediction)', 4)} AS mean_prediction, {r('sum(prediction)', 4)} AS total_prediction FROM forecast_rows GROUP BY 1, 2, 3""")
def i10(t):
    return bi.rollups(t.forecast_rows, ["source_dataset", "horizon", "product_key"])


@query("i10_top_products", f"""
SELECT product_key, {r('sum(prediction)', 4)} AS total_prediction, count(*) AS n FROM forecast_rows WHERE horizon = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def i10b(t):
    top = bi.rollups(t.forecasts_at([1]), ["product_key"]).select("product_key", "total_prediction", "n")
    return top.orderBy(F.desc("total_prediction"), "product_key").limit(10)


@query("i10_action_buckets", "SELECT stockout_risk_level, overstock_risk_level, reorder_triggered, count(*) AS n FROM risk_matrix GROUP BY 1, 2, 3")
def i10c(t):
    return t.risk_matrix.groupBy("stockout_risk_level", "overstock_risk_level", "reorder_triggered").agg(F.count("*").alias("n"))
