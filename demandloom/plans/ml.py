"""Model queries: checked by rows and invariants where SQL cannot fit a model."""

from functools import partial

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.functions.vocabulary import BACKTEST_FOLDS, HORIZONS, MIN_ZERO_SHARE, SYNTHETIC, UCI
from demandloom.operators import backtest, baselines, features, metrics, ml
from demandloom.plans.registry import QUERIES, query
from demandloom.plans.sqltext import ci, r
from demandloom.session import side_by_side, stored

KEYS = ["source_dataset", "product_key", "week"]
NUM, CAT = [*ml.WEEKLY_NUMERIC, *ml.HOLIDAY_NUMERIC], list(ml.WEEKLY_CATEGORICAL)
TREES = 20  # of the models of the queries; the operators' own default is ml.TREES (see the README)
PW = "PARTITION BY source_dataset, product_key ORDER BY week"


def _weekly_features(t):
    """Weekly features of both sources with holidays and product attributes."""
    rows = features.with_holidays(features.weekly_features(t.weekly_demand), t.weekly_calendar)
    return rows.join(t.dim_product.select("source_dataset", "product_key", "category", "sub_category", "brand"), ["source_dataset", "product_key"], "left")


def _weekly(t):
    """The same with chronological roles, stored."""
    return stored(ml.chronological(_weekly_features(t)), "weekly-features")


def _by_source(rows, fn):
    """One model per source: ``fn`` of each source's rows, with the source's name."""
    of = lambda s: fn(rows.where(F.col("source_dataset") == s)).withColumn("source_dataset", F.lit(s))
    parts = side_by_side(rows.sparkSession, [partial(of, s) for s in (UCI, SYNTHETIC)])
    return parts[0].unionByName(parts[1])


def _gbt(rows):
    return ml.fit(rows.where("split = 'train'"), NUM, ml.boosted(TREES), CAT)


@query("l1_training_rows", f"""
WITH f AS (SELECT source_dataset, week, units_sold, lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 13) OVER w AS lag_13 FROM weekly_demand WINDOW w AS ({PW})), s AS (SELECT source_dataset, min(week) AS lo, max(week) AS hi FROM f GROUP BY 1)
SELECT f.source_dataset, CASE WHEN week - lo < floor((hi - lo) * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN week - lo < floor((hi - lo) * CAST(0.9 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, {ci('lag_13 IS NULL')} AS missing_lag_13,
 CAST(sum(units_sold) AS DOUBLE) AS label_sum FROM f JOIN s ON f.source_dataset = s.source_dataset WHERE lag_1 IS NOT NULL GROUP BY 1, 2""")
def l1(t):
    rows = ml.with_indicators(_weekly(t), ["lag_13"])
    return rows.groupBy("source_dataset", "split").agg(F.count("*").alias("rows"), F.count_if(F.col("lag_13_missing") == 1).alias("missing_lag_13"), F.sum("label").alias("label_sum"))


@query("l2_candidate_comparison")
def l2(t):
    return _by_source(_weekly(t), lambda rows: ml.train_and_compare(rows, NUM, ml.candidates(TREES), CAT)[0])


@query("l3_nonnegative_predictions", f"""
SELECT source_dataset, count(*) AS n, {ci('p < 0')} AS negatives, {r('sum(p)', 4)} AS total FROM (SELECT source_dataset, CASE WHEN prediction IS NULL THEN CAST(0 AS DOUBLE) ELSE greatest(0, prediction - 10) END AS p FROM long_predictions WHERE model = 'naive') t GROUP BY 1""")
def l3(t):
    rows = baselines.long_predictions(t.baseline_predictions, ["naive"]).withColumn("raw", F.col("prediction") - 10)
    p = ml.nonnegative("raw")
    return rows.withColumn("p", p).groupBy("source_dataset").agg(F.count("*").alias("n"), F.count_if(F.col("p") < 0).alias("negatives"), rnd(F.sum("p"), 4).alias("total"))


@query("l4_native_importance")
def l4(t):
    rows = ml.with_indicators(_weekly(t), NUM)
    return _by_source(rows, lambda part: ml.native_importance(_gbt(part), part))


@query("l4_permutation_importance")
def l4b(t):
    rows = ml.with_indicators(_weekly(t), NUM)
    return _by_source(rows, lambda part: ml.permutation_importance(_gbt(part), part.where("split = 'validation'"), KEYS))


def _panel(t):
    w = features.series(features.GRAIN)
    cols = {**features.lags(features.GRAIN, "units_sold", (1, 2, 7), "date", "lag_"), "mean_7": F.avg("units_sold").over(features.trailing(w, 7)), "mean_30": F.avg("units_sold").over(features.trailing(w, 30))}
    return t.panel.withColumns(cols).where("lag_1 IS NOT NULL")


PANEL = ["lag_1", "lag_2", "lag_7", "mean_7", "mean_30"]


GATE = """SELECT source_dataset FROM panel WHERE split = 'train' GROUP BY 1 HAVING avg(CASE WHEN units_sold = 0 THEN 1 ELSE 0 END) >= 0.05"""


def _hurdles(t):
    """Threshold table of each source whose training rows have enough zeros."""
    rows = stored(_panel(t), "hurdle")
    share = F.avg((F.col("units_sold") == 0).cast("double"))
    gate = t.panel.where("split = 'train'").groupBy("source_dataset").agg(share.alias("zeros")).where(F.col("zeros") >= MIN_ZERO_SHARE)
    able = sorted(r.source_dataset for r in gate.collect())
    of = lambda s: ml.hurdle(rows.where(F.col("source_dataset") == s), PANEL, trees=TREES).withColumn("source_dataset", F.lit(s))
    out = None
    for part in side_by_side(t.spark, [partial(of, s) for s in able]):
        out = part if out is None else out.unionByName(part)
    return ml.hurdle(rows.limit(0), PANEL, trees=1).withColumn("source_dataset", F.lit("")) if out is None else out


@query("l5_hurdle")
def l5(t):
    return _hurdles(t)


@query("l5_hurdle_rows", f"""
SELECT p.source_dataset, split, threshold, count(*) AS n FROM (SELECT *, lag(units_sold) OVER (PARTITION BY source_dataset, entity_id, product_key ORDER BY date) AS lag_1 FROM panel) p JOIN ({GATE}) g ON p.source_dataset = g.source_dataset,
 (SELECT CAST(unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS DOUBLE) AS threshold) h WHERE split <> 'train' AND lag_1 IS NOT NULL GROUP BY 1, 2, 3""")
def l5_rows(t):
    """Every held-out row of the sources behind the gate is scored at every threshold."""
    return _hurdles(t).select("source_dataset", "split", "threshold", "n")


@query("l6_direct_horizons")
def l6(t):
    return ml.direct_horizons(features.direct_panel(_panel(t), HORIZONS), PANEL, HORIZONS, TREES)


@query("l7_conformal_intervals", f"""
WITH v AS (SELECT source_dataset, split, units_sold AS actual, moving_average_7 AS p FROM baseline_predictions WHERE moving_average_7 IS NOT NULL), q AS (SELECT source_dataset, quantile_cont(actual - p, 0.1) AS a, quantile_cont(actual - p, 0.5) AS b, quantile_cont(actual - p, 0.9) AS c FROM v WHERE split = 'validation' GROUP BY 1),
 i AS (SELECT v.source_dataset, actual, p, greatest(0, p + a) AS lo, greatest(0, p + b) AS mid, greatest(0, p + c) AS hi FROM v JOIN q ON v.source_dataset = q.source_dataset WHERE split = 'test')
SELECT source_dataset, count(*) AS n, {r('avg(CASE WHEN actual >= lo AND actual <= hi THEN 1 ELSE 0 END) * 100', 4)} AS coverage_pct, {r('avg(hi - lo)', 4)} AS mean_width, {r('sum(mid)', 4)} AS p50_total, {ci('lo > mid OR mid > hi')} AS crossings FROM i GROUP BY 1""")
def l7(t):
    rows = t.baseline_predictions.select("source_dataset", "split", F.col("units_sold").alias("actual"), F.col("moving_average_7").alias("prediction"))
    made = ml.conformal_intervals(rows).where("split = 'test'")
    lo, mid, hi = F.col("lower_bound"), F.col("p50"), F.col("upper_bound")
    inside = ((F.col("actual") >= lo) & (F.col("actual") <= hi)).cast("double")
    return made.groupBy("source_dataset").agg(
        F.count("*").alias("n"), rnd(F.avg(inside) * 100.0, 4).alias("coverage_pct"), rnd(F.avg(hi - lo), 4).alias("mean_width"), rnd(F.sum(mid), 4).alias("p50_total"),
        F.count_if((lo > mid) | (mid > hi)).alias("crossings"))


REGIME = "CASE WHEN p = 0 THEN 'zero' WHEN p <= q1 THEN 'low' WHEN p <= q2 THEN 'medium' ELSE 'high' END"


@query("l7_intervals_by_regime", f"""
WITH v AS (SELECT source_dataset, split, units_sold AS actual, moving_average_7 AS p FROM baseline_predictions WHERE moving_average_7 IS NOT NULL AND split <> 'train'),
 t AS (SELECT source_dataset, quantile_cont(p, 1 / CAST(3 AS DOUBLE)) AS q1, quantile_cont(p, 2 / CAST(3 AS DOUBLE)) AS q2 FROM v WHERE split = 'validation' AND p > 0 GROUP BY 1),
 g AS (SELECT v.*, {REGIME} AS regime FROM v JOIN t ON v.source_dataset = t.source_dataset),
 w AS (SELECT source_dataset, quantile_cont(actual - p, 0.1) AS a, quantile_cont(actual - p, 0.5) AS b, quantile_cont(actual - p, 0.9) AS c FROM g WHERE split = 'validation' GROUP BY 1),
 o AS (SELECT source_dataset, regime, quantile_cont(actual - p, 0.1) AS a, quantile_cont(actual - p, 0.5) AS b, quantile_cont(actual - p, 0.9) AS c FROM g WHERE split = 'validation' GROUP BY 1, 2 HAVING count(*) >= 50),
 i AS (SELECT g.source_dataset, g.split, g.regime, actual, greatest(0, p + COALESCE(o.a, w.a)) AS lo, greatest(0, p + COALESCE(o.b, w.b)) AS mid, greatest(0, p + COALESCE(o.c, w.c)) AS hi
  FROM g JOIN w ON g.source_dataset = w.source_dataset LEFT JOIN o ON g.source_dataset = o.source_dataset AND g.regime = o.regime)
SELECT source_dataset, split, regime, count(*) AS n, {r('avg(CASE WHEN actual >= lo AND actual <= hi THEN 1 ELSE 0 END) * 100', 4)} AS coverage_pct, {r('avg(hi - lo)', 4)} AS mean_width, {r('sum(mid)', 4)} AS p50_total, {ci('lo IS NULL')} AS without FROM i GROUP BY 1, 2, 3""")
def l7_regimes(t):
    known = baselines.attach_baselines(t.panel_since("val_start", 7))  # only the mean of seven rows is used
    rows = known.where("split <> 'train' AND moving_average_7 IS NOT NULL").select("source_dataset", "split", F.col("units_sold").alias("actual"), F.col("moving_average_7").alias("prediction"))
    made = ml.conformal_intervals(stored(ml.prediction_regimes(rows), "regimes"), within=["regime"])
    lo, hi = F.col("lower_bound"), F.col("upper_bound")
    return made.groupBy("source_dataset", "split", "regime").agg(
        F.count("*").alias("n"), rnd(F.avg(((F.col("actual") >= lo) & (F.col("actual") <= hi)).cast("double")) * 100.0, 4).alias("coverage_pct"), rnd(F.avg(hi - lo), 4).alias("mean_width"),
        rnd(F.sum("p50"), 4).alias("p50_total"), F.count_if(lo.isNull()).alias("without"))


def _recursive(t):
    rows = stored(t.panel, "panel")
    of = lambda s: ml.recursive(rows.where(F.col("source_dataset") == s), trees=TREES)
    parts = side_by_side(t.spark, [partial(of, s) for s in (UCI, SYNTHETIC)])
    return parts[0].unionByName(parts[1])


@query("l8_recursive_horizons")
def l8(t):
    return metrics.accuracy(_recursive(t), ["source_dataset", "horizon"])


@query("l8_recursive_rows", f"""
WITH p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY source_dataset, entity_id, product_key) AS n, lag(date) OVER w AS origin FROM panel WINDOW w AS (PARTITION BY source_dataset, entity_id, product_key ORDER BY date)),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset, entity_id, product_key ORDER BY date) - 1 AS j FROM p WHERE split = 'test') x WHERE j % CASE WHEN source_dataset = 'UCI' THEN 5 ELSE 7 END = 0 AND i > 1 AND i < n),
 h AS (SELECT CAST(unnest([{', '.join(map(str, HORIZONS))}]) AS INTEGER) AS horizon)
SELECT o.source_dataset, horizon, count(*) AS origins, count(DISTINCT concat(o.entity_id, '|', o.product_key)) AS series, CAST(sum(p.units_sold) AS DOUBLE) AS actual, min(o.origin) AS first_origin, max(p.date) AS last_target, CAST(0 AS BIGINT) AS negative
FROM o, h JOIN p ON p.source_dataset = o.source_dataset AND p.entity_id = o.entity_id AND p.product_key = o.product_key AND p.i = o.i - 1 + h.horizon GROUP BY 1, 2""")
def l8_rows(t):
    """Every origin of every series keeps each horizon it has rows for."""
    return _recursive(t).groupBy("source_dataset", "horizon").agg(
        F.count("*").alias("origins"), F.count_distinct(F.concat_ws("|", "entity_id", "product_key")).alias("series"), F.sum("actual").alias("actual"),
        F.min("origin_date").alias("first_origin"), F.max("target_date").alias("last_target"), F.count_if((F.col("prediction") < 0) | F.col("prediction").isNull()).alias("negative"))


@query("l9_walk_forward")
def l9(t):
    rows = _weekly(t)
    folds = stored(backtest.expanding_folds(rows.withColumnRenamed("week", "date"), BACKTEST_FOLDS, 91), "folds")
    scored = _by_source(rows, lambda part: ml.fold_models(part, folds, NUM, BACKTEST_FOLDS, ml.boosted(TREES), CAT))
    return metrics.accuracy(scored, ["source_dataset", "fold"], "label", "prediction")


@query("l10_tuning")
def l10(t):
    return _by_source(_weekly(t), lambda rows: ml.tune(rows, NUM, ml.grid(TREES), CAT))


@query("l11_weekly_candidate_backtest")
def l11(t):
    rows, tested = stored(_weekly_features(t), "weekly-features"), stored(t.backtest, "backtest")
    of = lambda df, source: df.where(F.col("source_dataset") == source)
    candidate = lambda s: ml.weekly_candidate(of(rows, s), of(tested, s), NUM, BACKTEST_FOLDS, ml.boosted(TREES), CAT)
    parts = side_by_side(t.spark, [partial(candidate, s) for s in (UCI, SYNTHETIC)])
    made = parts[0].unionByName(parts[1])
    return metrics.fold_wins(made)


@query("l12_batch_forecast")
def l12(t):
    rows = ml.with_indicators(_weekly(t), NUM)

    def forecast(part):
        model = _gbt(part)
        scored = ml.score(model, part.where("split <> 'train'")).select(*KEYS, "split", F.col("label").alias("actual"), "prediction")
        bounds = ml.conformal_intervals(stored(ml.prediction_regimes(scored), "scored"), within=["regime"]).select(*KEYS, "lower_bound", "upper_bound")
        return ml.batch_forecast(model, part.where("split <> 'train'"), bounds, KEYS)

    out = _by_source(rows, forecast)
    return out.withColumns({c: rnd(c, 6) for c in ("prediction", "lower_bound", "upper_bound")})


@query("l12_batch_rows", f"""
WITH f AS (SELECT *, lag(units_sold, 1) OVER w AS lag_1 FROM weekly_demand WINDOW w AS ({PW})), s AS (SELECT source_dataset, min(week) AS lo, max(week) AS hi FROM f GROUP BY 1)
SELECT f.source_dataset, count(*) AS rows, count(DISTINCT product_key) AS products, min(week) AS first_week, max(week) AS last_week, CAST(0 AS BIGINT) AS without_bounds, CAST(0 AS BIGINT) AS outside
FROM f JOIN s ON f.source_dataset = s.source_dataset WHERE lag_1 IS NOT NULL AND week - lo >= floor((hi - lo) * CAST(0.8 AS DOUBLE)) GROUP BY 1""")
def l12_rows(t):
    """One row for each held-out row of a series, with ordered bounds."""
    made = QUERIES["l12_batch_forecast"](t.spark, t.folder)
    return made.groupBy("source_dataset").agg(
        F.count("*").alias("rows"), F.count_distinct("product_key").alias("products"), F.min("week").alias("first_week"), F.max("week").alias("last_week"),
        F.count_if(F.col("lower_bound").isNull() | F.col("upper_bound").isNull()).alias("without_bounds"), F.count_if((F.col("lower_bound") > F.col("upper_bound")) | (F.col("lower_bound") < 0)).alias("outside"))


@query("l13_flat_multi_step")
def l13(t):
    rows = ml.with_indicators(_weekly(t), NUM)
    newest = lambda part: part.groupBy("source_dataset", "product_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in KEYS[:2]]), "week").alias("r")).select("source_dataset", "product_key", "r.*")
    return _by_source(rows, lambda part: ml.flat_multi_step(_gbt(part), newest(part))).withColumn("forecast_demand", rnd("forecast_demand", 6))
