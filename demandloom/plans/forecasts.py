"""Baseline forecast, backtest and accuracy queries."""

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.functions.vocabulary import DAILY_LAGS, DAILY_WINDOWS
from demandloom.operators import backtest, baselines, features, metrics, quality, risk, scenarios
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, ci, div, r
from demandloom.plans.views import MODELS
from demandloom.session import stored

KEYS = "source_dataset, entity_id, product_key"
GRAIN = list(features.GRAIN)


def acc(a="actual", p="prediction", digits=4):
    return f"""{r(f'avg(abs({a} - {p}))', digits)} AS mae, {r(f'sqrt(avg(({a} - {p}) * ({a} - {p})))', digits)} AS rmse,
 {r(f'avg(CASE WHEN {a} <> 0 THEN abs({a} - {p}) / abs({a}) END) * 100', digits)} AS mape, {r(f'avg(COALESCE(2 * abs({a} - {p}) / NULLIF(abs({a}) + abs({p}), 0), 0)) * 100', digits)} AS smape,
 {r(f'COALESCE(sum(abs({a} - {p})) / NULLIF(sum(abs({a})), 0) * 100, 0)', digits)} AS wape, count(*) AS n"""


OK = "actual IS NOT NULL AND prediction IS NOT NULL"
LONG_OK = "units_sold IS NOT NULL AND prediction IS NOT NULL"


# ---- baselines -------------------------------------------------------------------
def _baseline(column):
    return f"""SELECT source_dataset, split, count({column}) AS n, {r(f'sum({column})', 4)} AS total, {r(f'avg({column})', 6)} AS mean, {r(f'max({column})', 6)} AS highest,
 {r(f'corr({column}, units_sold)', 6)} AS corr_actual FROM baseline_predictions GROUP BY 1, 2"""


def _summed(t, column, expr):
    df = t.panel.withColumn(column, expr(features.series(features.GRAIN)))
    c = F.col(column)
    return df.groupBy("source_dataset", "split").agg(
        F.count(c).alias("n"), rnd(F.sum(c), 4).alias("total"), rnd(F.avg(c), 6).alias("mean"), rnd(F.max(c), 6).alias("highest"), rnd(F.corr(c, "units_sold"), 6).alias("corr_actual"))


@query("b1_naive", _baseline("naive"))
def b1(t):
    return _summed(t, "naive", baselines.naive)


@query("b2_seasonal_naive", _baseline("seasonal_naive"))
def b2(t):
    return _summed(t, "seasonal_naive", baselines.seasonal_naive)


@query("b3_moving_average", " UNION ALL ".join(f"SELECT {w} AS \"window\", * FROM ({_baseline(f'moving_average_{w}')}) x" for w in (7, 14, 30)))
def b3(t):
    df = t.panel.withColumns({f"m{w}": baselines.moving_average(features.series(features.GRAIN), w) for w in (7, 14, 30)})
    parts = df.select("source_dataset", "split", "units_sold", F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"m{w}").alias("v")) for w in (7, 14, 30)])).alias("x"))
    v = F.col("x.v")
    return parts.groupBy("x.window", "source_dataset", "split").agg(
        F.count(v).alias("n"), rnd(F.sum(v), 4).alias("total"), rnd(F.avg(v), 6).alias("mean"), rnd(F.max(v), 6).alias("highest"), rnd(F.corr(v, "units_sold"), 6).alias("corr_actual"))


@query("b4_historical_mean", _baseline("historical_mean"))
def b4(t):
    return _summed(t, "historical_mean", baselines.historical_mean)


@query("b5_all_baselines", f"""
SELECT source_dataset, product_key, count(*) AS rows, {', '.join(f"{r(f'sum({m})', 4)} AS {m}" for m in MODELS)} FROM baseline_predictions GROUP BY 1, 2""")
def b5(t):
    return t.baseline_predictions.groupBy("source_dataset", "product_key").agg(F.count("*").alias("rows"), *[rnd(F.sum(m), 4).alias(m) for m in MODELS])


@query("b6_multi_step", f"""
WITH p AS (SELECT {KEYS}, list(units_sold ORDER BY date) AS v, count(*) AS n FROM panel GROUP BY 1, 2, 3), s AS (SELECT unnest(range(1, 15)) AS step)
SELECT source_dataset, product_key, CAST(step AS INTEGER) AS step, {r('sum(v[n])', 6)} AS naive, {r('sum(list_avg(v[greatest(n - 6, 1):n]))', 6)} AS moving_average,
 {r('sum(CASE WHEN n < 7 THEN v[n] ELSE v[n - 7 + ((step - 1) % 7) + 1] END)', 6)} AS seasonal_naive FROM p, s GROUP BY 1, 2, 3""")
def b6(t):
    made = baselines.multi_step(t.panel, 14)
    return made.groupBy("source_dataset", "product_key", "step").agg(*[rnd(F.sum(c), 6).alias(c) for c in ("naive", "moving_average", "seasonal_naive")])


BT = "source_dataset, product_key, fold, forecast_origin, forecast_week, CAST(horizon_step AS INTEGER) AS horizon_step, actual, CAST(seasonal_naive_forecast AS DOUBLE) AS seasonal_naive_forecast"


@query("b7_seasonal_naive_52", f"SELECT {BT} FROM backtest")
def b7(t):
    return t.backtest.drop("candidate_forecast")


# closed forms of the recurrences: powers of the kept share over event positions
_P = f"PARTITION BY {KEYS}"
CROSTON = f"""
o AS (SELECT {KEYS}, date, split, units_sold AS y, row_number() OVER ({_P} ORDER BY date) - 1 AS t FROM panel),
s AS (SELECT *, CASE WHEN y > 0 THEN 1 ELSE 0 END AS hit FROM o WHERE t >= 1),
e AS (SELECT *, sum(hit) OVER ({_P} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k0,
      max(CASE WHEN hit = 1 THEN t END) OVER ({_P} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_hit FROM s),
g AS (SELECT *, COALESCE(k0, 0) AS k, CASE WHEN hit = 1 THEN t - COALESCE(last_hit, 0) END AS gap FROM e),
-- value of event j (1-based) weighs 0.1 * 0.9^(k-j); the first weighs 0.9^(k-1) when the series opens with demand
w AS (SELECT *, CASE WHEN hit = 1 THEN CASE WHEN k = 0 AND t = 1 THEN y ELSE CAST(0.1 AS DOUBLE) * y END * pow(CAST(0.9 AS DOUBLE), -(k + 1)) END AS zy,
      CASE WHEN hit = 1 THEN CASE WHEN k = 0 AND t = 1 THEN gap ELSE CAST(0.1 AS DOUBLE) * gap + CASE WHEN k = 0 THEN CAST(0.9 AS DOUBLE) ELSE 0 END END * pow(CAST(0.9 AS DOUBLE), -(k + 1)) END AS zp,
      hit * CAST(0.1 AS DOUBLE) * pow(CAST(0.9 AS DOUBLE), -t) AS zb FROM g),
c AS (SELECT {KEYS}, date, split, y, k, COALESCE(sum(zy) OVER h, 0) * pow(CAST(0.9 AS DOUBLE), k) AS level,
      CASE WHEN k = 0 THEN 1 ELSE sum(zp) OVER h * pow(CAST(0.9 AS DOUBLE), k) END AS gap, COALESCE(sum(zb) OVER h, 0) * pow(CAST(0.9 AS DOUBLE), t - 1) AS prob
      FROM w WINDOW h AS ({_P} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("b8_intermittent", f"""
WITH {CROSTON} SELECT source_dataset, product_key, count(*) AS n, {r('sum(y)', 8)} AS actual, {r('sum(level / gap)', 8)} AS croston, {r('sum(level / gap * CAST(0.95 AS DOUBLE))', 8)} AS sba, {r('sum(prob * level)', 8)} AS tsb
FROM c WHERE split = 'test' GROUP BY 1, 2""")
def b8(t):
    made = baselines.intermittent(t.panel)
    return made.groupBy("source_dataset", "product_key").agg(F.count("*").alias("n"), *[rnd(F.sum(c), 8).alias(c) for c in ("actual", "croston", "sba", "tsb")])


@query("b8_intermittent_accuracy", f"""
WITH {CROSTON}, l AS (SELECT source_dataset, 'croston' AS model, y AS actual, level / gap AS prediction FROM c WHERE split = 'test' UNION ALL SELECT source_dataset, 'sba', y, level / gap * CAST(0.95 AS DOUBLE) FROM c WHERE split = 'test'
 UNION ALL SELECT source_dataset, 'tsb', y, prob * level FROM c WHERE split = 'test') SELECT source_dataset, model, {acc()} FROM l GROUP BY 1, 2""")
def b8b(t):
    made = baselines.intermittent(t.panel).unpivot(["source_dataset", "actual"], ["croston", "sba", "tsb"], "model", "prediction")
    return metrics.accuracy(made, ["source_dataset", "model"])


@query("b9_zero_share_gate", f"""
SELECT source_dataset, count(*) AS rows, {r('avg(CASE WHEN units_sold = 0 THEN 1 ELSE 0 END) * 100', 4)} AS zero_share_pct, avg(CASE WHEN units_sold = 0 THEN 1 ELSE 0 END) >= 0.05 AS intermittent FROM panel GROUP BY 1""")
def b9(t):
    share = F.avg((F.col("units_sold") == 0).cast("double"))
    return t.panel.groupBy("source_dataset").agg(F.count("*").alias("rows"), rnd(share * 100.0, 4).alias("zero_share_pct"), (share >= 0.05).alias("intermittent"))


@query("b11_rolling_origin_folds", """
SELECT o.source_dataset, w.week, fold, origin FROM fold_origins o JOIN week_index w ON w.source_dataset = o.source_dataset AND w.idx > o.origin_idx AND w.idx <= o.origin_idx + 8""")
def b11(t):
    return backtest.fold_weeks(t.weekly_demand)


@query("b12_expanding_folds", f"""
WITH f AS (SELECT source_dataset, CAST(k AS INTEGER) AS fold, CAST(hi - CAST((4 - k) * 90 AS INTEGER) AS DATE) AS train_end, CAST(hi - CAST((4 - k) * 90 AS INTEGER) + 90 AS DATE) AS val_end
 FROM (SELECT source_dataset, max(date) AS hi FROM panel GROUP BY 1) s, (SELECT unnest(range(0, 4)) AS k) r)
SELECT p.source_dataset, fold, CASE WHEN date <= train_end THEN 'train' ELSE 'validation' END AS role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM panel p JOIN f ON p.source_dataset = f.source_dataset AND date <= val_end GROUP BY 1, 2, 3""")
def b12(t):
    rows = backtest.walk_forward(t.panel, backtest.expanding_folds(t.panel))
    return rows.groupBy("source_dataset", "fold", "role").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("flagship_weekly_backtest", f"""
SELECT source_dataset, product_key, {r('sum(abs(actual - candidate_forecast)) / NULLIF(sum(abs(actual)), 0) * 100', 4)} AS candidate_wape,
 {r('sum(abs(actual - seasonal_naive_forecast)) / NULLIF(sum(abs(actual)), 0) * 100', 4)} AS baseline_wape, count(*) AS n FROM backtest GROUP BY 1, 2""")
def flagship(t):
    y, c, s = F.col("actual"), F.col("candidate_forecast"), F.col("seasonal_naive_forecast")
    return t.backtest.groupBy("source_dataset", "product_key").agg(
        rnd(metrics.wape(y, c) * 100.0, 4).alias("candidate_wape"), rnd(metrics.wape(y, s) * 100.0, 4).alias("baseline_wape"), F.count("*").alias("n"))


# ---- metrics ---------------------------------------------------------------------
@query("m1_accuracy_by_product", f"SELECT source_dataset, product_key, horizon, {acc()} FROM forecast_rows WHERE {OK} GROUP BY 1, 2, 3")
def m1(t):
    return metrics.accuracy(t.forecast_rows, ["source_dataset", "product_key", "horizon"])


@query("m2_compact_metrics", f"""
WITH f AS (SELECT source_dataset, horizon, actual AS y, greatest(0, prediction) AS p FROM forecast_rows WHERE {OK})
SELECT source_dataset, horizon, {r('avg(abs(y - p))', 3)} AS mae, {r('sqrt(avg((y - p) * (y - p)))', 3)} AS rmse, {r('COALESCE(sum(abs(y - p)) / NULLIF(sum(y), 0) * 100, 0)', 2)} AS wape_pct,
 {r('least(avg(abs((y - p) / (y + CAST(0.00001 AS DOUBLE)))) * 100, 500)', 2)} AS mape_pct, {r('CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) ELSE 0 END', 4)} AS r2,
 {r('avg(p - y)', 3)} AS bias, count(*) AS sample_count FROM f GROUP BY 1, 2""")
def m2(t):
    return metrics.compact(t.forecast_rows, ["source_dataset", "horizon"])


EXT = f"""{acc()}, {r('avg(prediction - actual)', 4)} AS bias, {r('avg(actual - prediction)', 4)} AS mean_residual, {r('COALESCE(stddev_samp(actual - prediction), 0)', 4)} AS residual_std,
 {r('avg(CASE WHEN prediction > actual THEN 1 ELSE 0 END) * 100', 2)} AS overprediction_pct, {r('avg(CASE WHEN prediction < actual THEN 1 ELSE 0 END) * 100', 2)} AS underprediction_pct"""


@query("m3_extended_metrics", f"SELECT source_dataset, horizon, {EXT}, {r('quantile_cont(actual - prediction, 0.5)', 4)} AS median_residual FROM forecast_rows WHERE {OK} GROUP BY 1, 2")
def m3(t):
    return metrics.extended(t.forecast_rows, ["source_dataset", "horizon"])


ZERO = f"""{ci('actual = 0')} AS n_zero, {ci('actual <> 0')} AS n_nonzero, {r('count_if(actual = 0) / CAST(count(*) AS DOUBLE) * 100', 2)} AS zero_share_pct, {r('avg(CASE WHEN actual = 0 THEN abs(prediction) END)', 4)} AS zero_mae,
 {r('avg(CASE WHEN actual <> 0 THEN abs(actual - prediction) END)', 4)} AS nonzero_mae, {r('avg(CASE WHEN actual = 0 THEN CASE WHEN prediction > 0 THEN 1 ELSE 0 END END) * 100', 2)} AS zero_positive_prediction_rate,
 {r('count_if(prediction = 0) / CAST(count(*) AS DOUBLE) * 100', 2)} AS predicted_zero_rate"""


@query("m4_zero_slice", f"SELECT source_dataset, horizon, count(*) AS n, {ZERO} FROM forecast_rows WHERE {OK} GROUP BY 1, 2")
def m4(t):
    return metrics.zero_slice(t.forecast_rows, ["source_dataset", "horizon"])


def _pin(q, tau):
    return r(f"avg(CASE WHEN actual - {q} >= 0 THEN CAST({tau} AS DOUBLE) * (actual - {q}) ELSE (CAST({tau} AS DOUBLE) - 1) * (actual - {q}) END)", 4)


@query("m5_interval_quality", f"""
SELECT source_dataset, horizon, count(*) AS n, {r('avg(CASE WHEN actual >= lower_bound AND actual <= upper_bound THEN 1 ELSE 0 END) * 100', 4)} AS coverage_pct, {r('avg(upper_bound - lower_bound)', 4)} AS mean_width,
 {_pin('lower_bound', 0.1)} AS pinball_p10, {_pin('prediction', 0.5)} AS pinball_p50, {_pin('upper_bound', 0.9)} AS pinball_p90, {r('avg(CASE WHEN actual <= lower_bound THEN 1 ELSE 0 END) * 100', 2)} AS p10_below_pct,
 {r('avg(CASE WHEN actual <= upper_bound THEN 1 ELSE 0 END) * 100', 2)} AS p90_below_pct, {ci('lower_bound > upper_bound')} AS interval_crossing FROM forecast_rows WHERE lower_bound IS NOT NULL AND upper_bound IS NOT NULL GROUP BY 1, 2""")
def m5(t):
    return metrics.interval_quality(t.forecast_rows, ["source_dataset", "horizon"])


def _board(by, where="TRUE"):
    return f"SELECT {by}, {acc('units_sold', 'prediction')} FROM long_predictions WHERE {LONG_OK} AND {where} GROUP BY ALL"


@query("m6_leaderboard", f"SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY wape, mae, rmse, model) AS rank FROM ({_board('source_dataset, model', chr(39).join(['split = ', 'test', '']))}) t")
def m6(t):
    test = baselines.long_predictions(t.baseline_predictions).where("split = 'test'")
    return metrics.leaderboard(metrics.accuracy(test, ["source_dataset", "model"], "units_sold", "prediction"))


@query("m7_metrics_by_split", _board("split, source_dataset, model"))
def m7a(t):
    held_out = t.baseline_predictions.where(F.col("split").isin("validation", "test"))
    return metrics.accuracy_of_models(held_out, baselines.MODELS, ["split", "source_dataset"], "units_sold")


@query("m7_metrics_by_entity", _board("source_dataset, entity_id, model", "split = 'test'"))
def m7b(t):
    test = baselines.long_predictions(t.baseline_predictions).where("split = 'test'")
    return metrics.accuracy(test, ["source_dataset", "entity_id", "model"], "units_sold", "prediction")


@query("m8_high_value_segments", f"""
WITH rev AS (SELECT source_dataset, product_key, {r('sum(revenue)', 4)} AS revenue FROM panel GROUP BY 1, 2),
 c AS (SELECT *, (sum(revenue) OVER (PARTITION BY source_dataset ORDER BY revenue DESC, product_key ROWS UNBOUNDED PRECEDING) - revenue) / sum(revenue) OVER (PARTITION BY source_dataset) < 0.8 AS high FROM rev),
 s AS ({_board('source_dataset, entity_id, product_key', "split = 'test' AND model = 'historical_mean'")}),
 p AS (SELECT source_dataset, product_key, avg(wape) AS wape, avg(mae) AS mae, avg(rmse) AS rmse FROM s GROUP BY 1, 2)
SELECT source_dataset, CASE WHEN high THEN 'high_revenue' ELSE 'lower_revenue' END AS segment, n_skus, {r('seg / sum(seg) OVER (PARTITION BY source_dataset) * 100', 2)} AS revenue_share_pct, 'historical_mean' AS model, mae, rmse, wape
FROM (SELECT c.source_dataset, high, count(*) AS n_skus, sum(revenue) AS seg, {r('avg(mae)', 4)} AS mae, {r('avg(rmse)', 4)} AS rmse, {r('avg(wape)', 4)} AS wape FROM c LEFT JOIN p ON c.source_dataset = p.source_dataset AND c.product_key = p.product_key GROUP BY 1, 2) z
WHERE wape IS NOT NULL""")
def m8(t):
    revenue = t.panel.groupBy("source_dataset", "product_key").agg(rnd(F.sum("revenue"), 4).alias("revenue"))
    return metrics.high_value_segments(baselines.long_predictions(t.baseline_predictions), revenue, "historical_mean")


REGIME = """q AS (SELECT source_dataset, quantile_cont(actual, 1.0 / 3) AS q1, quantile_cont(actual, 2.0 / 3) AS q2 FROM forecast_rows WHERE actual <> 0 AND horizon = 1 GROUP BY 1),
 g AS (SELECT f.*, CASE WHEN actual = 0 THEN 'zero' WHEN actual <= q1 THEN 'low' WHEN actual <= q2 THEN 'medium' ELSE 'high' END AS regime FROM forecast_rows f LEFT JOIN q ON f.source_dataset = q.source_dataset WHERE horizon = 1)"""


@query("m9_regimes", f"WITH {REGIME} SELECT source_dataset, regime, {acc()} FROM g WHERE {OK} GROUP BY 1, 2")
def m9(t):
    return metrics.accuracy_by_regime(t.forecasts_at([1]))


@query("m10_zero_demand", f"""
SELECT source_dataset, count(*) AS n_total, {ci('actual = 0')} AS n_zero, {ci('actual <> 0')} AS n_nonzero, {r('count_if(actual = 0) / CAST(count(*) AS DOUBLE) * 100', 2)} AS zero_share_pct,
 {r('avg(CASE WHEN actual = 0 THEN abs(prediction) END)', 4)} AS zero_mae, {r('avg(CASE WHEN actual = 0 THEN prediction END)', 4)} AS zero_mean_prediction,
 {r('avg(CASE WHEN actual = 0 THEN CASE WHEN prediction > 0 THEN 1 ELSE 0 END END) * 100', 2)} AS zero_positive_prediction_rate, {r('avg(CASE WHEN actual <> 0 THEN abs(actual - prediction) END)', 4)} AS nonzero_mae,
 {r('sqrt(avg(CASE WHEN actual <> 0 THEN (actual - prediction) * (actual - prediction) END))', 4)} AS nonzero_rmse,
 {r('sum(CASE WHEN actual <> 0 THEN abs(actual - prediction) END) / sum(CASE WHEN actual <> 0 THEN abs(actual) END) * 100', 4)} AS nonzero_wape, {r('avg(CASE WHEN actual <> 0 THEN actual END)', 4)} AS nonzero_mean_actual,
 {r('avg(CASE WHEN actual <> 0 THEN prediction END)', 4)} AS nonzero_mean_prediction, {r('quantile_cont(CASE WHEN actual = 0 THEN prediction END, 0.5)', 4)} AS zero_median_prediction FROM forecast_rows WHERE horizon = 1 GROUP BY 1""")
def m10(t):
    return metrics.zero_demand_table(t.forecasts_at([1]))


def _ends(column, value, low, high):
    cuts = ", ".join(f"quantile_cont({column}, {p})" for p in (0, 0.2, 0.4, 0.6, 0.8, 1))
    return f"""SELECT source_dataset, {r('arg_min(v, b)', 4)} AS {low}, {r('arg_max(v, b)', 4)} AS {high} FROM (SELECT f.source_dataset, len(list_filter(e[2:len(e) - 1], lambda x: x < {column})) AS b, avg({value}) AS v
 FROM f JOIN (SELECT source_dataset, list_sort(list_distinct([{cuts}])) AS e FROM f GROUP BY 1) c ON f.source_dataset = c.source_dataset GROUP BY 1, 2) z GROUP BY 1"""


@query("m11_residual_diagnostics", f"""
WITH f AS (SELECT source_dataset, actual, prediction, actual - prediction AS res, abs(actual - prediction) AS ae FROM forecast_rows WHERE horizon = 1),
 a AS (SELECT source_dataset, count(*) AS n, {r('corr(actual, ae)', 4)} AS corr_abs_error_actual, {r('corr(prediction, ae)', 4)} AS corr_abs_error_prediction, {r('corr(actual, res)', 4)} AS corr_residual_actual,
  {r('corr(prediction, res)', 4)} AS corr_residual_prediction FROM f GROUP BY 1),
 p AS ({_ends('prediction', 'res', 'low_pred_mean_residual', 'high_pred_mean_residual')}), y AS ({_ends('actual', 'ae', 'low_actual_mae', 'high_actual_mae')})
SELECT a.*, p.* EXCLUDE (source_dataset), y.* EXCLUDE (source_dataset) FROM a LEFT JOIN p ON a.source_dataset = p.source_dataset LEFT JOIN y ON a.source_dataset = y.source_dataset""")
def m11(t):
    return metrics.residual_diagnostics(t.forecasts_at([1]))


BY_ENTITY = f"SELECT source_dataset, entity_id, {acc()} FROM forecast_rows WHERE {OK} AND horizon = 1 GROUP BY 1, 2"


@query("m12_error_by_month", f"SELECT source_dataset, horizon, strftime(forecast_date, '%Y-%m') AS month, {acc()} FROM forecast_rows WHERE {OK} GROUP BY 1, 2, 3")
def m12a(t):
    return metrics.accuracy(t.forecast_rows.withColumn("month", F.date_format("forecast_date", "yyyy-MM")), ["source_dataset", "horizon", "month"])


@query("m12_entity_spread", f"""
SELECT source_dataset, count(*) AS n_entities, arg_min(entity_id, (wape, entity_id)) AS best_entity, min(wape) AS best_wape, arg_min(entity_id, (-wape, entity_id)) AS worst_entity, max(wape) AS worst_wape,
 {r('max(wape) - min(wape)', 4)} AS spread_wape, {r('quantile_cont(wape, 0.5)', 4)} AS median_wape FROM ({BY_ENTITY}) t GROUP BY 1""")
def m12b(t):
    return metrics.entity_spread(metrics.accuracy(t.forecasts_at([1]), ["source_dataset", "entity_id"]))


@query("m13_stability", f"""
WITH w AS (SELECT source_dataset, fold, {r('COALESCE(sum(abs(actual - candidate_forecast)) / NULLIF(sum(abs(actual)), 0) * 100, 0)', 4)} AS wape FROM backtest GROUP BY 1, 2),
 s AS (SELECT source_dataset, count(*) AS folds, avg(wape) AS m, stddev_samp(wape) AS s, min(wape) AS lo, max(wape) AS hi FROM w GROUP BY 1)
SELECT source_dataset, folds, CASE WHEN folds < 2 THEN 'Unstable' WHEN s / m < 0.15 AND hi / lo < 1.5 THEN 'Stable' WHEN s / m < 0.35 AND hi / lo < 2 THEN 'Moderately Stable' ELSE 'Unstable' END AS label,
 {r('s / NULLIF(m, 0)', 4)} AS cv_wape, {r('hi / NULLIF(lo, 0)', 4)} AS range_ratio, {r('m', 4)} AS mean_wape, {r('s', 4)} AS std_wape, {r('lo', 4)} AS min_wape, {r('hi', 4)} AS max_wape FROM s""")
def m13(t):
    per = metrics.accuracy(t.backtest, ["source_dataset", "fold"], "actual", "candidate_forecast")
    return metrics.stability(per, ["source_dataset"])


PAIR = "sum(abs(actual - seasonal_naive_forecast)) / NULLIF(sum(abs(actual)), 0) AS bw, sum(abs(actual - candidate_forecast)) / NULLIF(sum(abs(actual)), 0) AS cw, avg(candidate_forecast - actual) AS b, count(*) AS n"
WINS = f"""SELECT source_dataset, fold, origin, val_start, val_end, n AS n_predictions, {r('bw * 100', 4)} AS baseline_wape_pct, {r('cw * 100', 4)} AS candidate_wape_pct, {r('b', 4)} AS candidate_bias, {r('(bw - cw) * 100', 3)} AS improvement_pp,
 COALESCE(cw < bw, FALSE) AS candidate_beats_baseline FROM (SELECT source_dataset, fold, min(forecast_origin) AS origin, min(forecast_week) AS val_start, max(forecast_week) AS val_end, {PAIR} FROM backtest GROUP BY 1, 2) t"""
FOLD = f"""SELECT source_dataset, beats AS folds_beating_baseline, total AS total_folds, CASE WHEN beats = total THEN 'STRONG' WHEN beats >= total * 0.7 THEN 'MODERATE' WHEN beats >= total * 0.4 THEN 'WEAK' ELSE 'FAILURE' END AS fold_stability
 FROM (SELECT source_dataset, {ci('candidate_beats_baseline')} AS beats, count(*) AS total FROM ({WINS}) w GROUP BY 1) t"""


@query("m14_fold_wins", WINS)
def m14a(t):
    return metrics.fold_wins(t.backtest)


@query("m14_fold_verdict", FOLD)
def m14b(t):
    return metrics.fold_verdict(metrics.fold_wins(t.backtest))


HTAB = f"SELECT source_dataset, CAST(horizon_step AS INTEGER) AS horizon_step, n, {r('bw * 100', 3)} AS baseline_wape, {r('cw * 100', 3)} AS candidate_wape, {r('b', 4)} AS candidate_bias FROM (SELECT source_dataset, horizon_step, {PAIR} FROM backtest GROUP BY 1, 2) t"
HVER = f"""SELECT source_dataset, CASE WHEN k >= 2 THEN d END AS degradation_pp, CASE WHEN k < 2 THEN 'INSUFFICIENT_DATA' WHEN abs(d) <= 5 THEN 'STABLE' WHEN d <= 15 THEN 'MODERATE_DEGRADATION' ELSE 'HIGH_DEGRADATION' END AS horizon_status
 FROM (SELECT source_dataset, count(*) AS k, {r('arg_max(candidate_wape, horizon_step) - arg_min(candidate_wape, horizon_step)', 2)} AS d FROM ({HTAB}) h WHERE candidate_wape IS NOT NULL GROUP BY 1) t"""


@query("m15_horizon_table", HTAB)
def m15a(t):
    return metrics.horizon_table(t.backtest)


@query("m15_horizon_verdict", HVER)
def m15b(t):
    return metrics.horizon_verdict(metrics.horizon_table(t.backtest))


SKUS = f"""SELECT t.source_dataset, product_key, n AS n_periods, {r('m', 2)} AS mean_demand, CASE WHEN m > p75 THEN 'HIGH' WHEN m < p25 THEN 'LOW' ELSE 'MID' END AS volume_class, {r('bw * 100', 2)} AS baseline_wape, {r('cw * 100', 2)} AS candidate_wape,
 {r('b', 2)} AS candidate_bias FROM s t JOIN (SELECT source_dataset, quantile_cont(m, 0.25) AS p25, quantile_cont(m, 0.75) AS p75 FROM s GROUP BY 1) q ON t.source_dataset = q.source_dataset"""
SKU_CTE = f"s AS (SELECT source_dataset, product_key, avg(actual) AS m, {PAIR} FROM backtest GROUP BY 1, 2)"


@query("m16_sku_errors", f"WITH {SKU_CTE} {SKUS}")
def m16a(t):
    return metrics.sku_errors(t.backtest)


@query("m16_sku_summary", f"""
WITH {SKU_CTE}, e AS ({SKUS}) SELECT source_dataset, count(*) AS total_skus, {ci('candidate_wape > 100')} AS high_error_skus, {ci('mean_demand = 0')} AS zero_demand_skus, {ci("volume_class = 'LOW'")} AS low_volume_skus, {ci("volume_class = 'HIGH'")} AS high_volume_skus,
 {r('quantile_cont(candidate_wape, 0.5)', 2)} AS median_sku_wape, {r('quantile_cont(candidate_wape, 0.75)', 2)} AS p75_sku_wape, {r('quantile_cont(candidate_wape, 0.9)', 2)} AS p90_sku_wape FROM e GROUP BY 1""")
def m16b(t):
    return metrics.sku_error_summary(t.backtest)


BIAS = f"""SELECT source_dataset, {r('b', 4)} AS overall_bias, CASE WHEN b > 0 THEN 'OVER_FORECAST' WHEN b < 0 THEN 'UNDER_FORECAST' ELSE 'NEUTRAL' END AS direction, {r('m', 4)} AS mean_demand, {r('abs(b) / NULLIF(m, 0)', 4)} AS relative_bias,
 CASE WHEN abs(b) / NULLIF(m, 0) < 0.05 THEN 'ACCEPTABLE' WHEN abs(b) / NULLIF(m, 0) < 0.15 THEN 'MODERATE' ELSE 'HIGH' END AS severity FROM (SELECT source_dataset, avg(candidate_forecast - actual) AS b, avg(actual) AS m FROM backtest GROUP BY 1) t"""


@query("m17_bias_review", BIAS)
def m17(t):
    return metrics.bias_review(t.backtest)


@query("m18_promotion_decision", f"""
WITH f AS ({FOLD}), h AS ({HVER}), b AS ({BIAS}) SELECT f.source_dataset, CASE WHEN f.source_dataset = 'UCI' OR fold_stability = 'FAILURE' OR folds_beating_baseline = 0 THEN 'KEEP AS RESEARCH CANDIDATE' ELSE 'PROMOTE WITH LIMITATIONS' END AS decision,
 concat_ws('; ', CASE WHEN fold_stability = 'FAILURE' THEN 'Fold stability failure' END, CASE WHEN folds_beating_baseline = 0 THEN 'Candidate never beats baseline' END) AS issues,
 concat_ws('; ', CASE WHEN fold_stability = 'WEAK' THEN 'Weak fold stability (WEAK)' END, CASE WHEN severity = 'HIGH' THEN concat('High bias (', direction, ')') END, CASE WHEN horizon_status = 'HIGH_DEGRADATION' THEN 'High horizon degradation' END,
  CASE WHEN f.source_dataset = 'UCI' THEN 'No inventory data: UCI can only be a demand forecasting candidate' END) AS warnings, fold_stability
FROM f LEFT JOIN h ON f.source_dataset = h.source_dataset LEFT JOIN b ON f.source_dataset = b.source_dataset""")
def m18(t):
    wins = metrics.fold_wins(t.backtest)
    grid = risk.consistency(t.sku_risk).select(F.col("consistency_status") == "PASS").scalar()
    daily = t.fact_sales.withColumns({
        **features.lags(GRAIN, "units_sold", DAILY_LAGS, "date", "units_sold_lag_"), **features.rolling(GRAIN, "units_sold", DAILY_WINDOWS, "date", ("mean",))})
    leaks = quality.leakage_checks(daily, GRAIN, DAILY_LAGS, DAILY_WINDOWS).agg((F.sum("violations") == 0).alias("ok")).select("ok").scalar()
    # the scenario model fitted and applied twice, over rows in another order
    keys, history = ["store_id", "sku_id"], stored(t.daily_units, "history")
    again = history.repartition(7, "sku_id")
    first, second = (scenarios.scenario(h, 1, keys, scenarios.fit_path(h, keys)).select(*keys, F.lit("all").alias("of"), F.col("forecast_units").alias("prediction")) for h in (history, again))
    repro = metrics.reproducibility(first, second, keys, []).agg(F.max("status").alias("s")).select("s").scalar()
    return metrics.promotion_decision(wins, metrics.fold_verdict(wins), metrics.horizon_verdict(metrics.horizon_table(t.backtest)), metrics.bias_review(t.backtest), leaks, grid, repro)


HOL = """hr AS (SELECT b.*, is_holiday_week, holiday_names, season, month, abs(actual - candidate_forecast) AS ae FROM backtest b LEFT JOIN weekly_calendar c ON b.forecast_week = c.week WHERE source_dataset = 'SYNTHETIC')"""


def _hol(t):
    return metrics.with_holiday_weeks(t.backtest.where("source_dataset = 'SYNTHETIC'"), t.weekly_calendar)


@query("m19_holiday_fold_summary", f"""
WITH {HOL} SELECT fold, origin, n AS n_predictions, {r('bw * 100', 3)} AS baseline_wape_pct, {r('cw * 100', 3)} AS candidate_wape_pct, {r('b', 3)} AS candidate_bias, hw AS holiday_weeks_in_val, {r('a', 2)} AS mean_actual, {r('f', 2)} AS mean_forecast
FROM (SELECT fold, min(forecast_origin) AS origin, {big('sum(COALESCE(is_holiday_week, 0))')} AS hw, avg(actual) AS a, avg(candidate_forecast) AS f, {PAIR} FROM hr GROUP BY 1) t""")
def m19a(t):
    return metrics.holiday_fold_summary(_hol(t))


@query("m19_late_fold_elevation", f"""
WITH {HOL}, x AS (SELECT *, fold IN (3, 4) AS late, candidate_forecast - actual AS e FROM hr) SELECT {big('sum(CASE WHEN late THEN COALESCE(is_holiday_week, 0) END)')} AS late_holiday_weeks, {r('avg(CASE WHEN late THEN actual END)', 2)} AS late_mean_demand,
 {r('avg(CASE WHEN NOT late THEN actual END)', 2)} AS other_mean_demand, {r('avg(CASE WHEN late THEN actual END) / greatest(avg(CASE WHEN NOT late THEN actual END), CAST(0.01 AS DOUBLE))', 3)} AS demand_elevation_ratio,
 {r('avg(CASE WHEN late THEN e END)', 3)} AS late_bias, {r('avg(CASE WHEN NOT late THEN e END)', 3)} AS other_bias FROM x""")
def m19b(t):
    return metrics.late_fold_elevation(_hol(t))


BREAK = f"{r('avg(actual)', 2)} AS mean_actual, {r('avg(candidate_forecast)', 2)} AS mean_forecast, {r('avg(ae)', 2)} AS mean_abs_error, {r('avg(candidate_forecast - actual)', 2)} AS bias, {r('sum(ae) / NULLIF(sum(abs(actual)), 0) * 100', 2)} AS wape_pct"


@query("m19_error_by_category", f"WITH {HOL} SELECT category, {BREAK} FROM hr LEFT JOIN sku_master k ON hr.product_key = concat('SYN_', k.sku_id) WHERE fold IN (3, 4) GROUP BY 1")
def m19c(t):
    skus = t.sku_master.select(F.concat(F.lit("SYN_"), "sku_id").alias("product_key"), "category")
    return metrics.error_breakdown(_hol(t).where(F.col("fold").isin(3, 4)).join(skus, "product_key", "left"), ["category"])


@query("m19_top_error_skus", f"WITH {HOL} SELECT product_key, {BREAK} FROM hr WHERE fold IN (3, 4) GROUP BY 1 ORDER BY mean_abs_error DESC, product_key LIMIT 15")
def m19d(t):
    return metrics.error_breakdown(_hol(t).where(F.col("fold").isin(3, 4)), ["product_key"]).orderBy(F.desc("mean_abs_error"), "product_key").limit(15)


@query("m19_period_detail", f"""
WITH {HOL} SELECT forecast_week, is_holiday_week, holiday_names, season, month, {r('sum(actual)', 1)} AS observed_demand, {r('sum(candidate_forecast)', 1)} AS forecast, {r('sum(candidate_forecast - actual)', 1)} AS forecast_error,
 {ci('ae > actual * 0.2')} AS affected_skus FROM hr WHERE fold IN (3, 4) GROUP BY 1, 2, 3, 4, 5""")
def m19e(t):
    return metrics.holiday_period_detail(_hol(t).where(F.col("fold").isin(3, 4)))


@query("m20_error_tail", f"""
WITH f AS (SELECT source_dataset, horizon, actual, prediction, abs(actual - prediction) AS ae FROM forecast_rows), q AS (SELECT source_dataset, horizon, quantile_cont(ae, 0.95) AS p95, quantile_cont(actual, 0.9) AS p90 FROM f GROUP BY 1, 2)
SELECT f.source_dataset, f.horizon, {r('max(p95)', 4)} AS p95_abs_error, {r('max(p90)', 4)} AS high_demand_cut, {ci('actual >= p90')} AS n_high_demand, {r('avg(CASE WHEN actual >= p90 THEN ae END)', 4)} AS high_demand_mae,
 {r('avg(CASE WHEN actual = 0 THEN ae END)', 4)} AS zero_demand_mae, {r('avg(prediction - actual)', 4)} AS bias FROM f JOIN q ON f.source_dataset = q.source_dataset AND f.horizon = q.horizon GROUP BY 1, 2""")
def m20(t):
    return metrics.error_tail(t.forecast_rows, ["source_dataset", "horizon"])


@query("m21_paired_comparison", f"""
WITH p AS (SELECT a.source_dataset, a.actual, a.prediction AS l, b.prediction AS rr FROM forecast_rows a JOIN forecast_rows b ON a.source_dataset = b.source_dataset AND a.entity_id = b.entity_id AND a.product_key = b.product_key AND a.forecast_date = b.forecast_date
 WHERE a.horizon = 7 AND b.horizon = 1), w AS (SELECT source_dataset, count(*) AS n, sum(abs(actual - l)) / NULLIF(sum(abs(actual)), 0) * 100 AS lw, sum(abs(actual - rr)) / NULLIF(sum(abs(actual)), 0) * 100 AS rw FROM p GROUP BY 1)
SELECT source_dataset, n AS n_matched, {r('lw', 4)} AS left_wape, {r('rw', 4)} AS right_wape, {r('lw - rw', 4)} AS absolute_improvement, {r('(lw - rw) / NULLIF(lw, 0) * 100', 4)} AS improvement_pct FROM w""")
def m21(t):
    at = lambda h: t.forecasts_at([h])
    return metrics.paired_comparison(at(7), at(1), [*GRAIN, "forecast_date"], ["source_dataset"])


SCORE = "(SELECT source_dataset, CASE WHEN actual > 0 THEN 1 ELSE 0 END AS label, prediction / (prediction + 5) AS score FROM forecast_rows WHERE horizon = 1) s"
GRID = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def _scores(t):
    return t.forecasts_at([1]).select("source_dataset", (F.col("actual") > 0).cast("int").alias("label"), (F.col("prediction") / (F.col("prediction") + 5)).alias("score"))


@query("m22_classifier_metrics", f"""
WITH c AS (SELECT source_dataset, threshold, count(*) AS n, {ci('label = 1 AND score >= threshold')} AS tp, {ci('label = 0 AND score >= threshold')} AS fp, {ci('label = 1 AND score < threshold')} AS fn, {ci('label = 0 AND score < threshold')} AS tn,
 {r('avg((score - label) * (score - label))', 4)} AS brier FROM {SCORE}, (SELECT CAST(unnest([{', '.join(map(str, GRID))}]) AS DOUBLE) AS threshold) g GROUP BY 1, 2)
SELECT *, {r('(tp + fn) / CAST(n AS DOUBLE) * 100', 2)} AS actual_positive_rate, {r('(tp + fp) / CAST(n AS DOUBLE) * 100', 2)} AS predicted_positive_rate, {r('(tp + tn) / CAST(n AS DOUBLE)', 4)} AS accuracy, {r(f"COALESCE({div('tp', 'tp + fp')}, 0)", 4)} AS precision,
 {r(f"COALESCE({div('tp', 'tp + fn')}, 0)", 4)} AS recall, {r(f"COALESCE({div('2 * tp', '2 * tp + fp + fn')}, 0)", 4)} AS f1, {r(f"{div('fp', 'tn + fp')} * 100", 2)} AS false_positive_demand_rate, {r(f"{div('fn', 'tp + fn')} * 100", 2)} AS false_negative_demand_rate FROM c""")
def m22a(t):
    return metrics.classifier_metrics(_scores(t), GRID, ["source_dataset"])


@query("m22_ranking_areas", f"""
WITH l AS (SELECT source_dataset, score AS s, {ci('label = 1')} AS p, {ci('label = 0')} AS q FROM {SCORE} GROUP BY 1, 2),
 c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY source_dataset) AS pp, sum(q) OVER (PARTITION BY source_dataset) AS nn FROM l WINDOW w AS (PARTITION BY source_dataset ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT source_dataset, {r('sum(q * (tp - p / CAST(2 AS DOUBLE))) / NULLIF(max(pp * nn), 0)', 4)} AS roc_auc, {r('sum(p * tp / CAST(NULLIF(pp * (tp + fp), 0) AS DOUBLE))', 4)} AS pr_auc FROM c GROUP BY 1""")
def m22b(t):
    return metrics.ranking_areas(_scores(t), ["source_dataset"])


@query("m23_hybrid_by_horizon", f"""
WITH h AS ({HTAB}), j AS (SELECT b.*, CASE WHEN candidate_wape <= baseline_wape THEN candidate_forecast ELSE seasonal_naive_forecast END AS sel, CASE WHEN candidate_wape <= baseline_wape THEN 'candidate' ELSE 'seasonal_naive' END AS selected_model
 FROM backtest b JOIN h ON b.source_dataset = h.source_dataset AND b.horizon_step = h.horizon_step)
SELECT source_dataset, CAST(horizon_step AS INTEGER) AS horizon_step, selected_model, count(*) AS n, {r('sum(sel)', 4)} AS selected_total, {r('sum(abs(actual - sel)) / NULLIF(sum(abs(actual)), 0) * 100', 4)} AS selected_wape FROM j GROUP BY 1, 2, 3""")
def m23a(t):
    made = metrics.hybrid_by_horizon(t.backtest)
    return made.groupBy("source_dataset", "horizon_step", "selected_model").agg(
        F.count("*").alias("n"), rnd(F.sum("selected_forecast"), 4).alias("selected_total"), rnd(metrics.wape(F.col("actual"), F.col("selected_forecast")) * 100.0, 4).alias("selected_wape"))


@query("m23_champion", f"""
SELECT source_dataset, CASE WHEN cw < bw THEN 'candidate' ELSE 'seasonal_naive' END AS champion, {r('least(cw, bw) * 100', 4)} AS champion_wape, {r('(bw - cw) * 100', 4)} AS improvement_pp FROM (SELECT source_dataset, {PAIR} FROM backtest GROUP BY 1) t""")
def m23b(t):
    return metrics.champion(t.backtest)


@query("m24_select_with_override", f"""
WITH m AS ({_board('source_dataset, model', "split = 'validation'")}), b AS (SELECT source_dataset, model AS best, wape AS best_wape FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY wape, mae, rmse, model) AS k FROM m) x WHERE k = 1)
SELECT b.*, i.wape AS incumbent_wape, {r('(i.wape - best_wape) / NULLIF(i.wape, 0) * 100', 4)} AS relative_gain_pct, CASE WHEN i.wape IS NOT NULL AND (i.wape - best_wape) / NULLIF(i.wape, 0) * 100 < 5 THEN 'moving_average_30' ELSE best END AS selected
FROM b LEFT JOIN m i ON b.source_dataset = i.source_dataset AND i.model = 'moving_average_30'""")
def m24(t):
    val = baselines.long_predictions(t.baseline_predictions).where("split = 'validation'")
    return metrics.select_with_override(metrics.accuracy(val, ["source_dataset", "model"], "units_sold", "prediction"), "moving_average_30", 5.0)


@query("m25_reproducibility", """
SELECT source_dataset, count(*) AS sample_size, CAST(0 AS BIGINT) AS unmatched, CAST(0 AS DOUBLE) AS max_prediction_diff, 'REPRODUCIBLE' AS status FROM backtest GROUP BY 1""")
def m25(t):
    keys = ["source_dataset", "product_key", "fold", "forecast_week"]
    again = backtest.rolling_origin(t.weekly_demand)
    pick = lambda d: d.select(*keys, F.col("candidate_forecast").alias("prediction"))
    out = metrics.reproducibility(pick(t.backtest), pick(again), keys, ["source_dataset"])
    return out.withColumn("max_prediction_diff", rnd("max_prediction_diff", 6))
