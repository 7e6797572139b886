"""Monitoring and streaming queries."""

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.functions.vocabulary import SYNTHETIC, WEEKLY_LAGS, WEEKLY_WINDOWS
from demandloom.operators import features, metrics, monitoring, quality, risk, star
from demandloom.plans.forecasts import EXT, OK, PAIR, REGIME, ZERO, acc
from demandloom.plans.registry import query
from demandloom.plans.sqltext import big, ci, r
from demandloom.session import stored
from demandloom.sources import files
from demandloom.streaming import admission, requests


@query("n1_forecast_distribution", f"""
SELECT source_dataset, horizon, count(*) AS n, {r('avg(prediction)', 6)} AS prediction_mean, {r('COALESCE(stddev_samp(prediction), 0)', 6)} AS prediction_std, {r('min(prediction)', 6)} AS prediction_min, {r('max(prediction)', 6)} AS prediction_max,
 {r('avg(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) * 100', 4)} AS zero_prediction_rate_pct, {r('avg(CASE WHEN actual = 0 THEN CASE WHEN prediction > 0 THEN 1 ELSE 0 END END) * 100', 4)} AS zero_false_positive_rate_pct,
 {r('quantile_cont(prediction, 0.5)', 6)} AS prediction_median FROM forecast_rows GROUP BY 1, 2""")
def n1(t):
    return monitoring.distribution(t.forecast_rows)


FEATURES = ["naive", "moving_average_7", "historical_mean"]
LONG = " UNION ALL ".join(f"SELECT source_dataset, split, '{f}' AS feature, {r(f, 6)} AS v FROM baseline_predictions" for f in FEATURES)
DECILES = ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(11))


def psi_sql(ref, cur, by):
    """PSI over relations with columns ``by`` and v."""
    on = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in by)
    keys, pre = ", ".join(by), lambda a: ", ".join(f"{a}.{c}" for c in by)
    return f"""e AS (SELECT {keys}, list_sort(list_distinct(quantile_cont(v, [{DECILES}]))) AS edges, count(v) AS ne FROM {ref} WHERE v IS NOT NULL GROUP BY {keys}),
 na AS (SELECT {keys}, count(v) AS na FROM {cur} WHERE v IS NOT NULL GROUP BY {keys}),
 bins AS (SELECT *, unnest(range(1, greatest(len(edges), 2))) AS b FROM e),
 rh AS (SELECT {pre('e')}, least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS b, count(*) AS c FROM {ref} f JOIN e ON {on.format('f', 'e')} WHERE v >= edges[1] AND v <= edges[len(edges)] GROUP BY ALL),
 ch AS (SELECT {pre('e')}, least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS b, count(*) AS c FROM {cur} f JOIN e ON {on.format('f', 'e')} WHERE v >= edges[1] AND v <= edges[len(edges)] GROUP BY ALL),
 m AS (SELECT {pre('bins')}, ne, len(edges) AS k, COALESCE(rh.c, 0) AS rc, COALESCE(ch.c, 0) AS cc FROM bins LEFT JOIN rh ON {on.format('bins', 'rh')} AND bins.b = rh.b LEFT JOIN ch ON {on.format('bins', 'ch')} AND bins.b = ch.b),
 s AS (SELECT *, greatest(rc / CAST(greatest(sum(rc) OVER (PARTITION BY {keys}), 1) AS DOUBLE), 1e-6) AS pe, greatest(cc / CAST(greatest(sum(cc) OVER (PARTITION BY {keys}), 1) AS DOUBLE), 1e-6) AS pa FROM m),
 p AS (SELECT {pre('s')}, max(ne) AS n_expected, max(na) AS n_actual, CASE WHEN max(ne) >= 20 AND max(na) >= 20 THEN CASE WHEN max(k) < 3 THEN 0 ELSE sum((pa - pe) * ln(pa / pe)) END END AS psi FROM s JOIN na ON {on.format('s', 'na')} GROUP BY {pre('s')})"""


KS_BY = "source_dataset, feature"


def ks_sql(ref, cur, by):
    keys = ", ".join(by)
    return f"""u AS (SELECT {keys}, v, 1 AS e, 0 AS a FROM {ref} WHERE v IS NOT NULL UNION ALL SELECT {keys}, v, 0, 1 FROM {cur} WHERE v IS NOT NULL),
 d AS (SELECT {keys}, v, sum(e) AS e, sum(a) AS a FROM u GROUP BY {keys}, v),
 w AS (SELECT {keys}, sum(e) OVER x / CAST(NULLIF(sum(e) OVER (PARTITION BY {keys}), 0) AS DOUBLE) AS fe, sum(a) OVER x / CAST(NULLIF(sum(a) OVER (PARTITION BY {keys}), 0) AS DOUBLE) AS fa, sum(e) OVER (PARTITION BY {keys}) AS ne, sum(a) OVER (PARTITION BY {keys}) AS na
  FROM d WINDOW x AS (PARTITION BY {keys} ORDER BY v ROWS UNBOUNDED PRECEDING)), k AS (SELECT {keys}, CASE WHEN max(ne) >= 20 AND max(na) >= 20 THEN max(abs(fe - fa)) END AS ks FROM w GROUP BY {keys})"""


def _sides(t):
    """Value counts of training and test rows, from one reading of the predictions."""
    rows = t.baseline_predictions.where(F.col("split").isin("train", "test")).select("source_dataset", "split", *[rnd(f, 6).alias(f) for f in FEATURES])
    long = rows.unpivot(["source_dataset", "split"], FEATURES, "feature", "v")
    return monitoring.counts_of_sides(long, BY, "v", F.col("split") == "train", F.col("split") == "test")


SIDES = f"l AS ({LONG}), ref AS (SELECT * FROM l WHERE split = 'train'), cur AS (SELECT * FROM l WHERE split = 'test')"
BY = ["source_dataset", "feature"]


@query("n2_population_stability", f"WITH {SIDES}, {psi_sql('ref', 'cur', BY)} SELECT source_dataset, feature, n_expected, n_actual, {r('psi', 6)} AS psi FROM p")
def n2(t):
    return monitoring.psi_of_counts(_sides(t), BY).withColumn("psi", rnd("psi", 6))


@query("n3_ks_statistic", f"WITH {SIDES}, {ks_sql('ref', 'cur', BY)} SELECT source_dataset, feature, {r('ks', 6)} AS ks FROM k")
def n3(t):
    return monitoring.ks_of_counts(_sides(t), BY).withColumn("ks", rnd("ks", 6))


def _moments(side, rel):
    return f"(SELECT feature, {r('avg(v)', 4)} AS {side}_mean, {r('stddev_samp(v)', 4)} AS {side}_std FROM {rel} GROUP BY 1)"


@query("n4_drift_table", f"""
WITH {SIDES}, {psi_sql('ref', 'cur', ['feature'])}, {ks_sql('ref', 'cur', ['feature'])} SELECT a.*, cur_mean, cur_std, {r('psi', 4)} AS psi, {r('ks', 4)} AS ks
FROM {_moments('ref', 'ref')} a LEFT JOIN {_moments('cur', 'cur')} c ON a.feature = c.feature LEFT JOIN p ON a.feature = p.feature LEFT JOIN k ON a.feature = k.feature""")
def n4(t):
    rows = stored(t.baseline_predictions.select("split", *[rnd(f, 6).alias(f) for f in FEATURES]), "drift")
    return monitoring.drift_table(rows.where("split = 'train'"), rows.where("split = 'test'"), FEATURES)


@query("n5_accuracy_tables", f"SELECT source_dataset, horizon, entity_id, {EXT}, {ZERO} FROM forecast_rows WHERE {OK} GROUP BY 1, 2, 3")
def n5(t):
    cols = [*metrics.accuracy_columns("actual", "prediction"), *metrics.extended_columns("actual", "prediction"), *metrics.zero_slice_columns("actual", "prediction")]
    return metrics.finite(t.forecast_rows, "actual", "prediction").groupBy("source_dataset", "horizon", "entity_id").agg(*cols)


@query("n5_accuracy_by_regime", f"WITH {REGIME.replace(' AND horizon = 1', '').replace(' WHERE horizon = 1', '')} SELECT source_dataset, regime, {EXT} FROM g WHERE {OK} GROUP BY 1, 2")
def n5b(t):
    rows = metrics.with_regime(t.forecast_rows)
    return metrics.finite(rows, "actual", "prediction").groupBy("source_dataset", "regime").agg(
        *metrics.accuracy_columns("actual", "prediction"), *metrics.extended_columns("actual", "prediction"))


@query("n6_alerts", f"""
WITH {SIDES}, {psi_sql('ref', 'cur', ['feature'])}, a AS (SELECT source_dataset, horizon, {acc()} FROM forecast_rows WHERE {OK} GROUP BY 1, 2),
 z AS (SELECT source_dataset, horizon, {r('avg(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) * 100', 4)} AS zr, {r('avg(CASE WHEN actual = 0 THEN CASE WHEN prediction > 0 THEN 1 ELSE 0 END END) * 100', 4)} AS fp FROM forecast_rows GROUP BY 1, 2),
 u AS (SELECT 'forecast_distribution_drift' AS code, concat('SYNTHETIC zero-prediction rate ', printf('%.4f', zr), ' outside 50.0-75.0') AS detail FROM z WHERE source_dataset = 'SYNTHETIC' AND horizon = 1 AND (zr < 50 OR zr > 75)
 UNION ALL SELECT 'zero_demand_false_positive_increase', concat('P(pred>0|actual=0)=', printf('%.4f', fp), ' > 10.0') FROM z WHERE source_dataset = 'SYNTHETIC' AND horizon = 1 AND fp > 10
 UNION ALL SELECT 'accuracy_degradation', concat('UCI h=1 WAPE ', printf('%.4f', wape), ' > 105.0') FROM a WHERE source_dataset = 'UCI' AND horizon = 1 AND wape > 105
 UNION ALL SELECT 'accuracy_degradation', concat('UCI h=1 WAPE ', printf('%.4f', wape), ' > 119.2') FROM a WHERE source_dataset = 'UCI' AND horizon = 1 AND wape > 119.2
 UNION ALL SELECT 'accuracy_degradation', concat('SYNTHETIC h=1 WAPE ', printf('%.4f', wape), ' > 39.4') FROM a WHERE source_dataset = 'SYNTHETIC' AND horizon = 1 AND wape > 39.4
 UNION ALL SELECT 'feature_drift', concat(feature, ' PSI=', printf('%.4f', {r('psi', 4)}), ' > 0.2') FROM p WHERE psi > 0.2)
SELECT DISTINCT code, 'warning' AS severity, detail FROM u""")
def n6(t):
    accuracy = metrics.accuracy(t.forecast_rows, ["source_dataset", "horizon"])
    grain = ["forecast_date", "horizon", *features.GRAIN]
    dups = quality.duplicates(t.forecast_rows, grain, "f").select(F.col("duplicate_rows").alias("n_duplicates"), F.col("duplicate_pct").alias("duplicate_rate_pct"))
    rows = stored(t.baseline_predictions.select("split", *[rnd(f, 6).alias(f) for f in FEATURES]), "drift")
    long = lambda s: rows.where(F.col("split") == s).unpivot([], FEATURES, "feature", "v")
    drift = monitoring.psi(long("train"), long("test"), ["feature"], "v").withColumn("psi", rnd("psi", 4))
    p, a = F.col("prediction"), F.col("actual")
    dist = t.forecast_rows.groupBy("source_dataset", "horizon").agg(
        rnd(F.avg((p == 0).cast("double")) * 100.0, 4).alias("zero_prediction_rate_pct"), rnd(F.avg(F.when(a == 0, (p > 0).cast("double"))) * 100.0, 4).alias("zero_false_positive_rate_pct"))
    return monitoring.alerts(accuracy, dist, dups, drift)


PW = "PARTITION BY source_dataset, product_key ORDER BY week"
WEEK_FEATURES = ["units_sold", *[f"lag_{k}" for k in WEEKLY_LAGS], *[f"rolling_{s}_{k}" for s in ("mean", "std") for k in WEEKLY_WINDOWS], "rolling_max_4", "rolling_max_13", "rolling_max_26", "price_lag1"]
WEEK_SIDES = f"""wf AS (SELECT week, CAST(units_sold AS DOUBLE) AS units_sold, {', '.join(f'CAST(lag(units_sold, {k}) OVER w AS DOUBLE) AS lag_{k}' for k in WEEKLY_LAGS)},
  {', '.join(r(f'{f}(units_sold) OVER ({PW} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)', 6) + f' AS rolling_{s}_{k}' for s, f in (('mean', 'avg'), ('std', 'stddev_samp')) for k in WEEKLY_WINDOWS)},
  {', '.join(f'CAST(max(units_sold) OVER ({PW} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS DOUBLE) AS rolling_max_{k}' for k in (4, 13, 26))},
  {r('lag(avg_unit_price, 1) OVER w', 6)} AS price_lag1 FROM weekly_demand WINDOW w AS ({PW})), wi AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM wf) q),
 l AS ({' UNION ALL '.join(f"SELECT week, '{f}' AS feature, {f} AS v FROM wf" for f in WEEK_FEATURES)}),
 ref AS (SELECT feature, v FROM l JOIN wi ON l.week = wi.week WHERE i <= floor(n * CAST(0.7 AS DOUBLE))), cur AS (SELECT feature, v FROM l JOIN wi ON l.week = wi.week WHERE i > n - greatest(1, floor(n / 5)))"""
DRIFT = f"""SELECT feature, n_expected, n_actual, {r('psi', 4)} AS psi, CASE WHEN psi IS NULL THEN 'INSUFFICIENT_DATA' WHEN psi < 0.10 THEN 'STABLE' WHEN psi < 0.20 THEN 'WATCH' WHEN psi < 0.25 THEN 'DRIFT' ELSE 'CRITICAL_DRIFT' END AS status FROM p"""


def _weekly_features(t, weekly=None):
    w = features.series(features.WEEKLY_GRAIN, "week")
    frame = lambda k: features.trailing(w, k)
    return (t.weekly_demand if weekly is None else weekly).withColumns({
        **{f"lag_{k}": F.lag("units_sold", k).over(w) for k in WEEKLY_LAGS},
        **{f"rolling_mean_{k}": rnd(F.avg("units_sold").over(frame(k)), 6) for k in WEEKLY_WINDOWS},
        **{f"rolling_std_{k}": rnd(F.stddev_samp("units_sold").over(frame(k)), 6) for k in WEEKLY_WINDOWS},
        **{f"rolling_max_{k}": F.max("units_sold").over(frame(k)).cast("double") for k in (4, 13, 26)}, "price_lag1": rnd(F.lag("avg_unit_price", 1).over(w), 6)})


@query("n7_data_drift", f"WITH {WEEK_SIDES}, {psi_sql('ref', 'cur', ['feature'])} {DRIFT}")
def n7(t):
    return monitoring.data_drift(_weekly_features(t), WEEK_FEATURES)


STATUS = "count_if(status = 'CRITICAL_DRIFT')"
DSTATUS = f"""SELECT count(*) AS features, {ci("status = 'CRITICAL_DRIFT'")} AS n_critical, {ci("status = 'DRIFT'")} AS n_drift, CASE WHEN {STATUS} >= 3 THEN 'FAIL' WHEN {STATUS} >= 1 OR count_if(status = 'DRIFT') >= 5 THEN 'WARNING' ELSE 'PASS' END AS overall_status"""


@query("n7_drift_status", f"WITH {WEEK_SIDES}, {psi_sql('ref', 'cur', ['feature'])} {DSTATUS} FROM ({DRIFT}) d")
def n7b(t):
    return monitoring.drift_status(monitoring.data_drift(_weekly_features(t), WEEK_FEATURES))


NEWEST = "(SELECT source_dataset, max(fold) AS newest FROM backtest GROUP BY 1)"


@query("n8_prediction_drift", f"""
WITH x AS (SELECT b.source_dataset, candidate_forecast AS v, fold = newest AS now FROM backtest b JOIN {NEWEST} m ON b.source_dataset = m.source_dataset),
 n AS (SELECT source_dataset, {r('avg(v)', 4)} AS m, {r('stddev_samp(v)', 4)} AS s, avg(CASE WHEN v = 0 THEN 1 ELSE 0 END) * 100 AS z, {r('quantile_cont(v, 0.25)', 4)} AS p25, {r('quantile_cont(v, 0.5)', 4)} AS median, {r('quantile_cont(v, 0.75)', 4)} AS p75 FROM x WHERE now GROUP BY 1),
 b AS (SELECT source_dataset, {r('avg(v)', 4)} AS bm, {r('stddev_samp(v)', 4)} AS bs FROM x WHERE NOT now GROUP BY 1),
 f AS (SELECT n.*, bm, bs, concat_ws(',', CASE WHEN bm > 0 AND abs((m - bm) / bm) > 0.3 THEN 'mean_shift' END, CASE WHEN bs > 0 AND s / bs > 2 THEN 'variance_explosion' END, CASE WHEN z > 50 THEN 'excessive_zero_forecasts' END) AS shifts FROM n LEFT JOIN b ON n.source_dataset = b.source_dataset)
SELECT source_dataset, m AS mean, median, s AS std, {r('z', 2)} AS zero_rate_pct, p25, p75, bm AS baseline_mean, bs AS baseline_std, {r('CASE WHEN bm > 0 THEN (m - bm) / bm * 100 END', 1)} AS mean_shift_pct, shifts, CASE WHEN shifts <> '' THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM f""")
def n8(t):
    """The newest fold of each source beside the folds before."""
    rows = stored(t.backtest, "backtest")
    newest = rows.groupBy("source_dataset").agg(F.max("fold").alias("newest"))
    rows = rows.join(newest, "source_dataset")
    return monitoring.prediction_drift(rows.where("fold = newest"), rows.where("fold < newest"), "candidate_forecast", "candidate_forecast", ["source_dataset"])


@query("n9_forecast_performance", f"""
WITH h AS (SELECT CAST(horizon_step AS INTEGER) AS horizon, CASE WHEN horizon_step <= 6 THEN 'PRODUCTION' ELSE 'EXTENDED_PARTIAL' END AS label, {PAIR} FROM backtest GROUP BY 1, 2), s AS (SELECT NULL, 'SUPPORTED', {PAIR} FROM backtest WHERE horizon_step <= 6), o AS (SELECT NULL, 'OVERALL', {PAIR} FROM backtest)
SELECT horizon, {r('cw * 100', 4)} AS wape_pct, {r('b', 4)} AS bias, n, label, CASE WHEN label <> 'OVERALL' THEN 'MEASURED' WHEN cw * 100 > 13.96 * 1.3 THEN 'FAIL' WHEN cw * 100 > 13.96 * 1.15 THEN 'WARNING' ELSE 'MEASURED' END AS status
FROM (SELECT * FROM h UNION ALL SELECT * FROM s UNION ALL SELECT * FROM o) u""")
def n9(t):
    return monitoring.forecast_performance(t.backtest)


def _hw(keep):
    return f"sum(CASE WHEN {keep} THEN abs(actual - candidate_forecast) END) / NULLIF(sum(CASE WHEN {keep} THEN abs(actual) END), 0) * 100"


@query("n10_holiday_performance", f"""
WITH b AS (SELECT x.*, COALESCE(is_holiday_week, 0) = 1 AS h FROM backtest x LEFT JOIN weekly_calendar c ON x.forecast_week = c.week),
 a AS (SELECT {ci('h')} AS holiday_rows, {r(_hw('h'), 4)} AS holiday_wape_pct, {r(_hw('NOT h'), 4)} AS non_holiday_wape_pct, {r('avg(CASE WHEN h THEN candidate_forecast - actual END)', 4)} AS holiday_bias, {r('avg(CASE WHEN NOT h THEN candidate_forecast - actual END)', 4)} AS non_holiday_bias FROM b)
SELECT *, CASE WHEN holiday_wape_pct > non_holiday_wape_pct * 1.3 THEN 'WARNING' ELSE 'PASS' END AS status FROM a""")
def n10(t):
    return monitoring.holiday_performance(t.backtest, t.weekly_calendar)


def _components(t):
    """(component, status) of the checks above."""
    named = lambda name, df, c: df.select(F.lit(name).alias("component"), F.col(c).alias("status"))
    weekly = star.weekly_sku(t.sales_daily)
    perf = monitoring.forecast_performance(t.backtest).where("label = 'OVERALL'")
    return quality.union([
        named("data_quality", quality.weekly_quality(weekly), "overall_status"),
        named("data_drift", monitoring.drift_status(monitoring.data_drift(_weekly_features(t), WEEK_FEATURES)), "overall_status"),
        named("forecast_performance", perf, "status"), named("risk_consistency", risk.consistency(t.sku_risk), "overall_status"),
    ])


COMPONENTS = f"""{WEEK_SIDES}, {psi_sql('ref', 'cur', ['feature'])}, comp AS (
 SELECT 'data_drift' AS component, (SELECT overall_status FROM ({DSTATUS} FROM ({DRIFT}) d) x) AS status
 UNION ALL SELECT 'forecast_performance', (SELECT CASE WHEN cw * 100 > 13.96 * 1.3 THEN 'FAIL' WHEN cw * 100 > 13.96 * 1.15 THEN 'WARNING' ELSE 'MEASURED' END FROM (SELECT {PAIR} FROM backtest) q)
 UNION ALL SELECT 'risk_consistency', (SELECT CASE WHEN count_if(recommended_action = 'REORDER NOW') > 0.8 * count(*) THEN 'WARNING' ELSE 'PASS' END FROM sku_risk)
 UNION ALL SELECT 'data_quality', (SELECT CASE WHEN min(k) < 90 THEN 'WARNING' ELSE 'PASS' END FROM (SELECT count(DISTINCT product_key) AS k FROM weekly_sku) y))"""


@query("n11_health_score", f"""
WITH {COMPONENTS} SELECT count(*) AS components, {ci("status = 'FAIL'")} AS n_fail, {ci("status = 'WARNING'")} AS n_warning, CASE WHEN count_if(status = 'FAIL') > 0 THEN 'CRITICAL' WHEN count_if(status = 'WARNING') >= 2 THEN 'DEGRADED'
 WHEN count_if(status = 'WARNING') >= 1 THEN 'WATCH' ELSE 'HEALTHY' END AS health_score FROM comp""")
def n11(t):
    return monitoring.health(_components(t))


@query("n11_component_alerts", f"""
WITH {COMPONENTS} SELECT component, CASE WHEN status = 'FAIL' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CASE component WHEN 'data_quality' THEN 'Review data ingestion pipeline' WHEN 'data_drift' THEN 'Investigate drift in input features'
 WHEN 'forecast_performance' THEN 'Review forecast performance vs baseline' ELSE 'Investigate inventory inputs and risk logic' END AS recommended_action FROM comp WHERE status IN ('FAIL', 'WARNING')""")
def n11b(t):
    return monitoring.component_alerts(_components(t))


@query("n12_drift_scenarios", " UNION ALL ".join(f"SELECT '{n}' AS scenario, TRUE AS pass" for n in (
    "missing_critical_feature", "high_missing_rate", "demand_shift", "sku_coverage_collapse", "excessive_zeros", "risk_inconsistency")))
def n12(t):
    """Each perturbed copy of the real tables must raise its own signal."""
    weekly = star.weekly_sku(t.sales_daily)
    feats = _weekly_features(t, weekly)
    late = F.col("week") > F.lit("2000-01-01").cast("date")
    named = lambda name, df, ok: df.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("pass")).select(F.lit(name).alias("scenario"), "pass")
    contract = quality.feature_contract
    gaps = feats.withColumn("lag_1", F.when(F.pmod(F.xxhash64("product_key"), F.lit(2)) == 0, F.col("lag_1")))
    shifted = _weekly_features(t, weekly.withColumn("units_sold", F.when(late, F.col("units_sold") * 3).otherwise(F.col("units_sold"))))
    few = weekly.where(F.col("product_key").isin("SYN_SKU_1", "SYN_SKU_2"))
    zero = t.backtest.withColumn("candidate_forecast", F.lit(0.0))
    broken = t.sku_risk.withColumns({"recommended_action": F.lit("HEALTHY"), "stockout_risk_level": F.lit("CRITICAL")})
    return quality.union([
        named("missing_critical_feature", contract(feats.drop("lag_1"), ["lag_1", "rolling_mean_4"]), (F.col("feature") == "lag_1") & (F.col("status") == "FAIL")),
        named("high_missing_rate", contract(gaps, ["lag_1", "rolling_mean_4"]), (F.col("feature") == "lag_1") & (F.col("status") != "PASS")),
        named("demand_shift", monitoring.drift_status(monitoring.data_drift(shifted, WEEK_FEATURES)), F.col("overall_status") != "PASS"),
        named("sku_coverage_collapse", quality.weekly_quality(few, SYNTHETIC), F.col("sku_coverage") == "WARNING"),
        named("excessive_zeros", monitoring.prediction_drift(zero, t.backtest, "candidate_forecast", "candidate_forecast"), F.col("shifts").contains("excessive_zero_forecasts")),
        named("risk_inconsistency", risk.consistency(broken), F.col("consistency_status") == "FAIL"),
    ])


@query("n13_manifest_difference", """
SELECT concat('year=', CAST(y AS VARCHAR)) AS path, CASE WHEN y = (SELECT max(year(l_shipdate)) FROM lineitem) THEN 'REMOVED' WHEN y = 1996 THEN 'CHANGED' ELSE 'SAME' END AS state FROM (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem) t""")
def n13(t):
    before = t.table("lineitem").withColumn("year", F.year("l_shipdate"))
    newest = before.agg(F.max("year").alias("m")).select("m").scalar()
    after = before.where(F.col("year") < newest).withColumn("l_quantity", F.when(F.col("year") == 1996, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return monitoring.compare_manifests(files.fingerprint(before, ["year"]), files.fingerprint(after, ["year"]))


# ---- request log -----------------------------------------------------------------------
T1 = f"""count(*) AS request_count, {ci("event_type = 'error'")} AS error_count, {r("count_if(event_type = 'error') / CAST(count(*) AS DOUBLE)", 4)} AS error_rate, {r('avg(value)', 3)} AS mean_latency_ms,
 {r("avg(CAST(json_extract(props, '$.k') AS DOUBLE))", 3)} AS mean_batch_size"""


@query("t1_request_metrics", f"SELECT date_trunc('hour', ts) AS window_start, {T1} FROM events GROUP BY 1")
def t1(t):
    return requests.windowed_metrics(t.table("events"))


@query("t1_request_metrics_stream", f"""
SELECT date_trunc('hour', ts) AS window_start, {T1} FROM events GROUP BY 1""")
def t1s(t):
    """Every window of a drained file stream, whatever the order of its files."""
    stream = requests.windowed_metrics(requests.event_stream(t.spark, t.folder))
    return requests.run_updates(stream, requests.stream_folder(t.spark, "metrics"), ["window_start"])


LIMIT, SPAN = 2, 21600


@query("t2_trailing_breaches", f"""
SELECT user_id, event_id, n AS in_window FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {SPAN} SECOND PRECEDING AND CURRENT ROW) AS n FROM events) t WHERE n > {LIMIT}""")
def t2a(t):
    return requests.trailing_breaches(t.table("events"), LIMIT, SPAN).drop("ts")


@query("t2_sliding_breaches", f"""
SELECT user_id, w AS window_start, count(*) AS n FROM (SELECT user_id, unnest([b, b - INTERVAL 3 HOUR]) AS w FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INTEGER)) AS b FROM events) e) t
GROUP BY 1, 2 HAVING count(*) > {LIMIT}""")
def t2b(t):
    return requests.sliding_breaches(t.table("events"), LIMIT, "6 hours", "3 hours")


# admitted times of the window travel along each user's events, in order
@query("t2_admission_stream", f"""
WITH RECURSIVE numbered AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walked(user_id, event_id, ts, k, held, admitted) AS (
  SELECT user_id, event_id, ts, k, [us], {LIMIT} > 0 FROM numbered WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, ts, k, CASE WHEN len(held) < {LIMIT} THEN list_append(held, us) ELSE held END, len(held) < {LIMIT}
  FROM (SELECT n.user_id, n.event_id, n.ts, n.k, n.us, list_filter(w.held, lambda x: x >= n.us - {SPAN * 1_000_000}) AS held FROM walked w JOIN numbered n ON n.user_id IS NOT DISTINCT FROM w.user_id AND n.k = w.k + 1))
SELECT user_id, event_id, ts, admitted FROM walked""")
def t2c(t):
    """Exact sliding-window admission with per-key state (rejected requests do not count)."""
    return admission.drain(t.spark, t.folder, LIMIT, SPAN)


AUDIT = """SELECT event_id, event_type AS event, json_extract_string(props, '$.k') AS k, '[REDACTED]' AS token, CASE WHEN length(rep) > 500 THEN concat(substr(rep, 1, 500), '…') ELSE rep END AS note
FROM (SELECT *, repeat(concat(event_type, ' '), 100) AS rep FROM events) e"""


def _audit(df):
    f = lambda k: F.get_json_object("record", f"$.{k}").alias(k)
    return df.select("event_id", "event", f("k"), f("token"), f("note"))


@query("t3_audit_records", AUDIT)
def t3(t):
    return _audit(requests.audit_records(t.table("events")))


@query("t3_audit_stream", AUDIT)
def t3s(t):
    stream = requests.audit_records(requests.event_stream(t.spark, t.folder))
    return _audit(requests.run_available(stream, requests.stream_folder(t.spark, "audit")))


# the sensitive value stands one to five levels deep, as an object, a list or a text
@query("t3_nested_redaction", """
SELECT event_id, concat(repeat('{"a":', d), '{"password":"[REDACTED]","k":', CAST(event_id AS VARCHAR), '}', repeat('}', d)) AS record FROM (SELECT event_id, CAST(event_id % 5 AS INTEGER) AS d FROM events) e""")
def t3_nested(t):
    deep = (F.col("event_id") % 5).cast("int")
    value = F.when(F.col("event_id") % 3 == 0, F.lit('{"v":{"w":[1,{"x":2}]}}')).when(F.col("event_id") % 3 == 1, F.lit("[[1],[2,[3]]]")).otherwise(F.lit('"secret"'))
    text = F.concat(F.repeat(F.lit('{"a":'), deep), F.lit('{"password":'), value, F.lit(',"k":'), F.col("event_id").cast("string"), F.lit("}"), F.repeat(F.lit("}"), deep))
    return t.table("events").select("event_id", requests.redact(text, F.lit("{}")).alias("record"))
