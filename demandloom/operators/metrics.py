"""Forecast accuracy and error diagnostics.

Every table is one grouped aggregate with map-side partial sums, whatever the
group; medians and quantiles over large groups go through ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.quantiles import exact_quantiles, quantile_table, quantiles_of_counts
from demandloom.functions.scan import running_totals
from demandloom.functions.semantics import ratio, rnd
from demandloom.functions.vocabulary import SUPPORTED_HORIZON_WEEKS
from demandloom.session import stored


def finite(df: DataFrame, *columns: str) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        keep = keep & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return df.where(keep)


def wape(a: Column, p: Column) -> Column:
    """Sum of absolute errors over sum of absolute actuals; NULL without demand."""
    return ratio(F.sum(F.abs(a - p)), F.sum(F.abs(a)))


def accuracy_columns(a: str, p: str) -> list[Column]:
    y, f = F.col(a).cast("double"), F.col(p).cast("double")
    err = F.abs(y - f)
    return [
        rnd(F.avg(err), 4).alias("mae"),
        rnd(F.sqrt(F.avg((y - f) * (y - f))), 4).alias("rmse"),
        rnd(F.avg(F.when(y != 0, err / F.abs(y))) * 100.0, 4).alias("mape"),
        rnd(F.avg(F.when(err.isNotNull(), F.coalesce(F.try_divide(2.0 * err, F.abs(y) + F.abs(f)), F.lit(0.0)))) * 100.0, 4).alias("smape"),
        rnd(F.coalesce(wape(y, f) * 100.0, F.lit(0.0)), 4).alias("wape"),
        F.count("*").alias("n"),
    ]


def accuracy(df: DataFrame, by: Sequence[str], actual="actual", prediction="prediction") -> DataFrame:
    return finite(df, actual, prediction).groupBy(*by).agg(*accuracy_columns(actual, prediction))


def accuracy_of_models(df: DataFrame, models: Sequence[str], by: Sequence[str], actual="actual") -> DataFrame:
    """``accuracy`` of several prediction columns side by side: one row for each group and model, from one pass over wide rows."""
    y = F.col(actual).cast("double")
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    for m in models:
        p = F.col(m).cast("double")
        both = usable(y) & usable(p)
        df = df.withColumns({f"_y_{m}": F.when(both, y), f"_p_{m}": F.when(both, p)})
    tables = []
    for m in models:
        columns = accuracy_columns(f"_y_{m}", f"_p_{m}")[:-1]  # all but the count of rows
        tables.append(F.struct(F.lit(m).alias("model"), *columns, F.count(f"_p_{m}").alias("n")))
    made = df.groupBy(*by).agg(F.array(*tables).alias("_t")).select(*by, F.inline("_t"))
    return made.where(F.col("n") > 0)


def compact(df: DataFrame, by: Sequence[str], actual="actual", prediction="prediction") -> DataFrame:
    """Alternative table: floored predictions, R2, capped MAPE with epsilon, bias."""
    y = F.col(actual).cast("double")
    f = F.greatest(F.lit(0.0), F.col(prediction).cast("double"))
    err = F.abs(y - f)
    sse, sst = F.sum((y - f) * (y - f)), F.var_pop(y) * F.count(y)
    mape = F.avg(F.abs((y - f) / (y + 1e-5))) * 100.0
    return finite(df, actual, prediction).groupBy(*by).agg(
        rnd(F.avg(err), 3).alias("mae"), rnd(F.sqrt(F.avg((y - f) * (y - f))), 3).alias("rmse"),
        rnd(F.coalesce(ratio(F.sum(err), F.sum(y)) * 100.0, F.lit(0.0)), 2).alias("wape_pct"),
        rnd(F.least(mape, F.lit(500.0)), 2).alias("mape_pct"),
        rnd(F.when((F.count(y) > 1) & (F.var_pop(y) > 0), 1.0 - sse / sst).otherwise(0.0), 4).alias("r2"),
        rnd(F.avg(f - y), 3).alias("bias"), F.count("*").alias("sample_count"),
    )


def extended_columns(a: str, p: str) -> list[Column]:
    y, f = F.col(a).cast("double"), F.col(p).cast("double")
    share = lambda c: rnd(F.avg(c.cast("double")) * 100.0, 2)
    return [
        rnd(F.avg(f - y), 4).alias("bias"), rnd(F.avg(y - f), 4).alias("mean_residual"),
        rnd(F.coalesce(F.stddev_samp(y - f), F.lit(0.0)), 4).alias("residual_std"),
        share(f > y).alias("overprediction_pct"), share(f < y).alias("underprediction_pct"),
    ]


def extended(df: DataFrame, by: Sequence[str], actual="actual", prediction="prediction") -> DataFrame:
    rows = finite(df, actual, prediction)
    table = rows.groupBy(*by).agg(*accuracy_columns(actual, prediction), *extended_columns(actual, prediction))
    residual = rows.withColumn("_res", F.col(actual).cast("double") - F.col(prediction))
    median = exact_quantiles(residual, "_res", [0.5], by, ["_m"])
    return table.join(median.select(*by, rnd("_m", 4).alias("median_residual")), list(by), "left")


def zero_slice_columns(a: str, p: str) -> list[Column]:
    y, f = F.col(a).cast("double"), F.col(p).cast("double")
    zero, err = y == 0, F.abs(y - f)
    n = F.count("*")
    return [
        F.count_if(zero).alias("n_zero"), F.count_if(~zero).alias("n_nonzero"),
        rnd(ratio(F.count_if(zero), n) * 100.0, 2).alias("zero_share_pct"),
        rnd(F.avg(F.when(zero, err)), 4).alias("zero_mae"), rnd(F.avg(F.when(~zero, err)), 4).alias("nonzero_mae"),
        rnd(F.avg(F.when(zero, (f > 0).cast("double"))) * 100.0, 2).alias("zero_positive_prediction_rate"),
        rnd(ratio(F.count_if(f == 0), n) * 100.0, 2).alias("predicted_zero_rate"),
    ]


def zero_slice(df: DataFrame, by: Sequence[str], actual="actual", prediction="prediction") -> DataFrame:
    return finite(df, actual, prediction).groupBy(*by).agg(F.count("*").alias("n"), *zero_slice_columns(actual, prediction))


def pinball(y: Column, q: Column, tau: float) -> Column:
    e = y - q
    return F.avg(F.when(e >= 0, tau * e).otherwise((tau - 1.0) * e))


def interval_quality(df: DataFrame, by: Sequence[str]) -> DataFrame:
    y, lo, hi = F.col("actual"), F.col("lower_bound"), F.col("upper_bound")
    share = lambda c: F.avg(c.cast("double")) * 100.0
    rows = df.where(y.isNotNull() & lo.isNotNull() & hi.isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), rnd(share((y >= lo) & (y <= hi)), 4).alias("coverage_pct"),
        rnd(F.avg(hi - lo), 4).alias("mean_width"), rnd(pinball(y, lo, 0.1), 4).alias("pinball_p10"),
        rnd(pinball(y, F.col("prediction"), 0.5), 4).alias("pinball_p50"), rnd(pinball(y, hi, 0.9), 4).alias("pinball_p90"),
        rnd(share(y <= lo), 2).alias("p10_below_pct"), rnd(share(y <= hi), 2).alias("p90_below_pct"),
        F.count_if(lo > hi).alias("interval_crossing"),
    )


def leaderboard(metrics: DataFrame, by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """Models ranked per source by WAPE, MAE, RMSE; the name settles ties."""
    w = Window.partitionBy(*by).orderBy("wape", "mae", "rmse", "model")
    return metrics.withColumn("rank", F.row_number().over(w))


def pareto_members(revenue: DataFrame, cut: float = 0.8) -> DataFrame:
    """Products whose preceding cumulative revenue share is below ``cut``.

    ``revenue`` holds one row per product, so a window covers a source's
    products; shares are taken from a two-level running sum (see ``running_share``).
    """
    shared = running_share(revenue, ["source_dataset"], "revenue", "product_key")
    return shared.withColumn("high_value", F.col("share_before") < cut)


def running_share(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Descending cumulative share and rank without one task per group; ``key`` settles ties (see ``scan``)."""
    table = stored(df.withColumn("_one", F.lit(1).cast("long")), "ranked")
    out = running_totals(table, by, [F.desc(value), F.col(key)], {"rank": "_one", "_run": value})
    return out.withColumns({
        "cumulative_share": ratio("_run", "_run_all"),
        "share_before": ratio(F.col("_run") - F.col(value), "_run_all"),
        "rank_pct": ratio("rank", "rank_all"),
    }).drop("_one", "_run", "_run_all", "_run_before", "rank_all", "rank_before")


def high_value_segments(predictions: DataFrame, revenue: DataFrame, model: str) -> DataFrame:
    """Mean product-level accuracy of Pareto products against the rest."""
    members = pareto_members(revenue)
    per_series = accuracy(
        predictions.where((F.col("split") == "test") & (F.col("model") == model)),
        ["source_dataset", "entity_id", "product_key"], "units_sold", "prediction",
    )
    per_product = per_series.groupBy("source_dataset", "product_key").agg(
        F.avg("wape").alias("wape"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")
    )
    joined = members.join(per_product, ["source_dataset", "product_key"], "left")
    segments = joined.groupBy("source_dataset", "high_value").agg(
        F.count("*").alias("n_skus"), F.sum("revenue").alias("seg_revenue"), rnd(F.avg("mae"), 4).alias("mae"),
        rnd(F.avg("rmse"), 4).alias("rmse"), rnd(F.avg("wape"), 4).alias("wape"),
    )
    totals = Window.partitionBy("source_dataset")
    return segments.where(F.col("wape").isNotNull()).select(
        "source_dataset", F.when(F.col("high_value"), "high_revenue").otherwise("lower_revenue").alias("segment"), "n_skus",
        rnd(ratio("seg_revenue", F.sum("seg_revenue").over(totals)) * 100.0, 2).alias("revenue_share_pct"),
        F.lit(model).alias("model"), "mae", "rmse", "wape",
    )


def with_regime(df: DataFrame, actual: str = "actual", by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """zero, or low/medium/high by tertiles of positive demand in the group."""
    cuts = exact_quantiles(df.where(F.col(actual) != 0), actual, [1 / 3, 2 / 3], by, ["_q1", "_q2"]).drop("n")
    y = F.col(actual)
    marked = df.join(cuts, list(by), "left").withColumn(
        "regime", F.when(y == 0, "zero").when(y <= F.col("_q1"), "low").when(y <= F.col("_q2"), "medium").otherwise("high")
    )
    return marked.drop("_q1", "_q2")


def accuracy_by_regime(df: DataFrame, by: Sequence[str] = ("source_dataset",), actual="actual", prediction="prediction") -> DataFrame:
    """Accuracy per demand regime from error sums per distinct actual value.

    The regime depends on the actual value only, so one pass reduces the rows to
    (group, actual) sums; tertiles and metrics both follow from that table.
    """
    by = list(by)
    y, f = F.col(actual).cast("double"), F.col(prediction).cast("double")
    err = F.abs(y - f)
    smape = F.coalesce(F.try_divide(2.0 * err, F.abs(y) + F.abs(f)), F.lit(0.0))
    sums = finite(df, actual, prediction).groupBy(*by, y.alias("_v")).agg(
        F.count("*").alias("_c"), F.sum(err).alias("_ae"), F.sum((y - f) * (y - f)).alias("_se"), F.sum(smape).alias("_sm"),
    )
    sums = stored(sums, "error-sums")
    cuts = quantiles_of_counts(sums.where("_v <> 0").select(*by, "_v", "_c"), [1 / 3, 2 / 3], by, ["_q1", "_q2"]).drop("n")
    v = F.col("_v")
    rows = sums.join(cuts, by, "left").withColumn(
        "regime", F.when(v == 0, "zero").when(v <= F.col("_q1"), "low").when(v <= F.col("_q2"), "medium").otherwise("high")
    )
    n = F.sum("_c")
    return rows.groupBy(*by, "regime").agg(
        rnd(ratio(F.sum("_ae"), n), 4).alias("mae"), rnd(F.sqrt(ratio(F.sum("_se"), n)), 4).alias("rmse"),
        rnd(ratio(F.sum(F.when(v != 0, F.col("_ae") / F.abs(v))), F.sum(F.when(v != 0, F.col("_c")))) * 100.0, 4).alias("mape"),
        rnd(ratio(F.sum("_sm"), n) * 100.0, 4).alias("smape"),
        rnd(F.coalesce(ratio(F.sum("_ae"), F.sum(F.abs(v) * F.col("_c"))) * 100.0, F.lit(0.0)), 4).alias("wape"), n.alias("n"),
    )


def zero_demand_table(df: DataFrame, by: Sequence[str] = ("source_dataset",), actual="actual", prediction="prediction") -> DataFrame:
    y, f = F.col(actual).cast("double"), F.col(prediction)
    zero, err = y == 0, F.abs(y - f)
    rows = finite(df, actual, prediction)
    table = rows.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count_if(zero).alias("n_zero"), F.count_if(~zero).alias("n_nonzero"),
        rnd(ratio(F.count_if(zero), F.count("*")) * 100.0, 2).alias("zero_share_pct"),
        rnd(F.avg(F.when(zero, err)), 4).alias("zero_mae"), rnd(F.avg(F.when(zero, f)), 4).alias("zero_mean_prediction"),
        rnd(F.avg(F.when(zero, (f > 0).cast("double"))) * 100.0, 2).alias("zero_positive_prediction_rate"),
        rnd(F.avg(F.when(~zero, err)), 4).alias("nonzero_mae"),
        rnd(F.sqrt(F.avg(F.when(~zero, err * err))), 4).alias("nonzero_rmse"),
        rnd(ratio(F.sum(F.when(~zero, err)), F.sum(F.when(~zero, F.abs(y)))) * 100.0, 4).alias("nonzero_wape"),
        rnd(F.avg(F.when(~zero, y)), 4).alias("nonzero_mean_actual"),
        rnd(F.avg(F.when(~zero, f)), 4).alias("nonzero_mean_prediction"),
    )
    medians = exact_quantiles(rows.where(zero), prediction, [0.5], by, ["_m"])
    return table.join(medians.select(*by, rnd("_m", 4).alias("zero_median_prediction")), list(by), "left")


def bin_by_quantile(df: DataFrame, columns: Sequence[str], parts: int, by: Sequence[str]) -> DataFrame:
    """Equal-frequency bin ``<column>_bin`` per column: right-closed intervals,
    repeated edges dropped."""
    probs = [i / parts for i in range(parts + 1)]
    cuts = quantile_table(df, columns, probs, by)
    joined = df.join(cuts, list(by))
    for c in columns:
        names = [f"{c}_q{i}" for i in range(parts + 1)]
        joined = joined.withColumn(f"{c}_bin", _bin_number(F.col(c).cast("double"), F.array_distinct(F.array(*names)))).drop(*names)
    return joined


def _bin_number(value: Column, edges: Column) -> Column:
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < value))


def residual_diagnostics(df: DataFrame, by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """Error correlations, and the mean error in the outer quintiles.

    The binned rows are totalled per (group, both bins), at most 25 rows each,
    which serve the correlations' counterpart tables without another scan.
    """
    rows = finite(df, "actual", "prediction").withColumns({
        "_res": F.col("actual") - F.col("prediction"), "_abs": F.abs(F.col("actual") - F.col("prediction")),
    })
    corr = rows.groupBy(*by).agg(
        F.count("*").alias("n"), rnd(F.corr("actual", "_abs"), 4).alias("corr_abs_error_actual"),
        rnd(F.corr("prediction", "_abs"), 4).alias("corr_abs_error_prediction"),
        rnd(F.corr("actual", "_res"), 4).alias("corr_residual_actual"),
        rnd(F.corr("prediction", "_res"), 4).alias("corr_residual_prediction"),
    )
    cells = bin_by_quantile(rows, ["prediction", "actual"], 5, by).groupBy(*by, "prediction_bin", "actual_bin").agg(
        F.count("*").alias("_n"), F.sum("_res").alias("_r"), F.sum("_abs").alias("_a")
    )
    whole = Window.partitionBy(*by)
    ends = cells.withColumns({
        "_pl": F.min("prediction_bin").over(whole), "_ph": F.max("prediction_bin").over(whole),
        "_al": F.min("actual_bin").over(whole), "_ah": F.max("actual_bin").over(whole),
    })
    mean = lambda b, at, v: rnd(ratio(F.sum(F.when(F.col(b) == F.col(at), F.col(v))), F.sum(F.when(F.col(b) == F.col(at), F.col("_n")))), 4)
    outer = ends.groupBy(*by).agg(
        mean("prediction_bin", "_pl", "_r").alias("low_pred_mean_residual"), mean("prediction_bin", "_ph", "_r").alias("high_pred_mean_residual"),
        mean("actual_bin", "_al", "_a").alias("low_actual_mae"), mean("actual_bin", "_ah", "_a").alias("high_actual_mae"),
    )
    return corr.join(outer, list(by), "left")


def entity_spread(by_entity: DataFrame) -> DataFrame:
    """Best, median and worst entity of each source."""
    table = by_entity.groupBy("source_dataset").agg(
        F.count("*").alias("n_entities"), F.min_by("entity_id", F.struct("wape", "entity_id")).alias("best_entity"),
        F.min("wape").alias("best_wape"),
        F.min_by("entity_id", F.struct((-F.col("wape")).alias("w"), "entity_id")).alias("worst_entity"),
        F.max("wape").alias("worst_wape"), rnd(F.max("wape") - F.min("wape"), 4).alias("spread_wape"),
    )
    median = exact_quantiles(by_entity, "wape", [0.5], ["source_dataset"], ["_m"])
    return table.join(median.select("source_dataset", rnd("_m", 4).alias("median_wape")), "source_dataset")


def stability(values: DataFrame, by: Sequence[str], value: str = "wape") -> DataFrame:
    """Coefficient of variation and max/min ratio of fold errors, with a label."""
    stats = values.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    )
    cv, spread = ratio("std", "mean"), ratio("hi", "lo")
    label = (
        F.when(F.col("folds") < 2, "Unstable").when((cv < 0.15) & (spread < 1.5), "Stable")
        .when((cv < 0.35) & (spread < 2.0), "Moderately Stable").otherwise("Unstable")
    )
    return stats.select(
        *by, "folds", label.alias("label"), rnd(cv, 4).alias("cv_wape"), rnd(spread, 4).alias("range_ratio"),
        rnd("mean", 4).alias("mean_wape"), rnd("std", 4).alias("std_wape"), rnd("lo", 4).alias("min_wape"), rnd("hi", 4).alias("max_wape"),
    )


# ---- promotion gate over backtest rows ----------------------------------------
def _both(extra: Sequence[Column] = ()) -> list[Column]:
    y, base, cand = F.col("actual"), F.col("seasonal_naive_forecast"), F.col("candidate_forecast")
    has = cand.isNotNull()
    return [
        F.count("*").alias("n"), wape(y, base).alias("_bw"),
        ratio(F.sum(F.when(has, F.abs(y - cand))), F.sum(F.when(has, F.abs(y)))).alias("_cw"),
        F.avg(cand - y).alias("_bias"), *extra,
    ]


def fold_wins(backtest: DataFrame) -> DataFrame:
    """Baseline against candidate on every fold."""
    table = backtest.groupBy("source_dataset", "fold").agg(*_both([
        F.min("forecast_origin").alias("origin"), F.min("forecast_week").alias("val_start"), F.max("forecast_week").alias("val_end"),
    ]))
    return table.select(
        "source_dataset", "fold", "origin", "val_start", "val_end", F.col("n").alias("n_predictions"),
        rnd(F.col("_bw") * 100.0, 4).alias("baseline_wape_pct"), rnd(F.col("_cw") * 100.0, 4).alias("candidate_wape_pct"),
        rnd("_bias", 4).alias("candidate_bias"), rnd((F.col("_bw") - F.col("_cw")) * 100.0, 3).alias("improvement_pp"),
        F.coalesce(F.col("_cw") < F.col("_bw"), F.lit(False)).alias("candidate_beats_baseline"),
    )


def fold_verdict(wins: DataFrame) -> DataFrame:
    beats, total = F.col("folds_beating_baseline"), F.col("total_folds")
    return wins.groupBy("source_dataset").agg(
        F.count_if("candidate_beats_baseline").alias("folds_beating_baseline"), F.count("*").alias("total_folds")
    ).withColumn(
        "fold_stability",
        F.when(beats == total, "STRONG").when(beats >= total * 0.7, "MODERATE").when(beats >= total * 0.4, "WEAK").otherwise("FAILURE"),
    )


def horizon_table(backtest: DataFrame) -> DataFrame:
    return backtest.groupBy("source_dataset", "horizon_step").agg(*_both()).select(
        "source_dataset", "horizon_step", "n", rnd(F.col("_bw") * 100.0, 3).alias("baseline_wape"),
        rnd(F.col("_cw") * 100.0, 3).alias("candidate_wape"), rnd("_bias", 4).alias("candidate_bias"),
    )


def horizon_verdict(table: DataFrame) -> DataFrame:
    valid = table.where(F.col("candidate_wape").isNotNull())
    grown = rnd(F.max_by("candidate_wape", "horizon_step") - F.min_by("candidate_wape", "horizon_step"), 2)
    out = valid.groupBy("source_dataset").agg(F.count("*").alias("_n"), grown.alias("degradation_pp"))
    d = F.col("degradation_pp")
    status = (
        F.when(F.col("_n") < 2, "INSUFFICIENT_DATA").when(F.abs(d) <= 5, "STABLE")
        .when(d <= 15, "MODERATE_DEGRADATION").otherwise("HIGH_DEGRADATION")
    )
    return out.select("source_dataset", F.when(F.col("_n") >= 2, d).alias("degradation_pp"), status.alias("horizon_status"))


def _sku_table(backtest: DataFrame) -> DataFrame:
    return backtest.groupBy("source_dataset", "product_key").agg(*_both([F.avg("actual").alias("mean_actual")])).withColumn(
        "candidate_wape", rnd(F.col("_cw") * 100.0, 2)
    )


def _volume(low: str, high: str) -> Column:
    m = F.col("mean_actual")
    return F.when(m > F.col(high), "HIGH").when(m < F.col(low), "LOW").otherwise("MID")


def sku_errors(backtest: DataFrame) -> DataFrame:
    """Per-product errors with a volume class by P25/P75 of mean demand."""
    table = _sku_table(backtest)
    cuts = exact_quantiles(table, "mean_actual", [0.25, 0.75], ["source_dataset"], ["_p25", "_p75"]).drop("n")
    return table.join(cuts, "source_dataset").select(
        "source_dataset", "product_key", F.col("n").alias("n_periods"), rnd("mean_actual", 2).alias("mean_demand"),
        _volume("_p25", "_p75").alias("volume_class"), rnd(F.col("_bw") * 100.0, 2).alias("baseline_wape"),
        "candidate_wape", rnd("_bias", 2).alias("candidate_bias"),
    )


def sku_error_summary(backtest: DataFrame) -> DataFrame:
    """Spread of product errors; demand and error quantiles come from one pass."""
    table = _sku_table(backtest)
    cuts = quantile_table(table, ["mean_actual", "candidate_wape"], [0.25, 0.5, 0.75, 0.9], ["source_dataset"])
    joined = table.join(cuts, "source_dataset").withColumn("_class", _volume("mean_actual_q0", "mean_actual_q2"))
    at = lambda q: rnd(F.max(f"candidate_wape_q{q}"), 2)
    return joined.groupBy("source_dataset").agg(
        F.count("*").alias("total_skus"), F.count_if(F.col("candidate_wape") > 100).alias("high_error_skus"),
        F.count_if(rnd("mean_actual", 2) == 0).alias("zero_demand_skus"), F.count_if(F.col("_class") == "LOW").alias("low_volume_skus"),
        F.count_if(F.col("_class") == "HIGH").alias("high_volume_skus"), at(1).alias("median_sku_wape"), at(2).alias("p75_sku_wape"), at(3).alias("p90_sku_wape"),
    )


def bias_review(backtest: DataFrame) -> DataFrame:
    rows = backtest.where(F.col("candidate_forecast").isNotNull())
    stats = rows.groupBy("source_dataset").agg(
        F.avg(F.col("candidate_forecast") - F.col("actual")).alias("b"), F.avg("actual").alias("m")
    )
    relative = ratio(F.abs("b"), "m")
    return stats.select(
        "source_dataset", rnd("b", 4).alias("overall_bias"),
        F.when(F.col("b") > 0, "OVER_FORECAST").when(F.col("b") < 0, "UNDER_FORECAST").otherwise("NEUTRAL").alias("direction"),
        rnd("m", 4).alias("mean_demand"), rnd(relative, 4).alias("relative_bias"),
        F.when(relative < 0.05, "ACCEPTABLE").when(relative < 0.15, "MODERATE").otherwise("HIGH").alias("severity"),
    )


def promotion_decision(wins, fold, horizon, bias, leakage_ok: Column, grid_ok: Column, reproducibility: Column) -> DataFrame:
    """Issues and warnings of every source as arrays, and the decision they imply."""
    best = wins.groupBy("source_dataset").agg(F.count_if("candidate_beats_baseline").alias("_beats"))
    table = fold.join(best, "source_dataset").join(horizon, "source_dataset", "left").join(bias, "source_dataset", "left")
    online = F.col("source_dataset") == "UCI"
    flag = lambda c, text: F.when(c, F.lit(text) if isinstance(text, str) else text)
    issues = F.array_compact(F.array(
        flag(~leakage_ok, "Leakage detected"), flag(reproducibility == "NOT_REPRODUCIBLE", "Not reproducible"),
        flag(F.col("fold_stability") == "FAILURE", "Fold stability failure"),
        flag(F.col("_beats") == 0, "Candidate never beats baseline"),
    ))
    warnings = F.array_compact(F.array(
        flag(reproducibility == "MINOR_NONDETERMINISM", "Minor nondeterminism in scoring"),
        flag(F.col("fold_stability") == "WEAK", "Weak fold stability (WEAK)"),
        flag(F.col("severity") == "HIGH", F.concat(F.lit("High bias ("), "direction", F.lit(")"))),
        flag(F.col("horizon_status") == "HIGH_DEGRADATION", "High horizon degradation"),
        flag(~online & ~grid_ok, "Decision grid inconsistency"),
        flag(online, "No inventory data: UCI can only be a demand forecasting candidate"),
    ))
    held = (F.size("issues") > 0) | online
    return table.select("source_dataset", "fold_stability", issues.alias("issues"), warnings.alias("warnings")).select(
        "source_dataset", F.when(held, "KEEP AS RESEARCH CANDIDATE").otherwise("PROMOTE WITH LIMITATIONS").alias("decision"),
        F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"), "fold_stability",
    )


# ---- holiday diagnostics -------------------------------------------------------
def with_holiday_weeks(backtest: DataFrame, weekly_calendar: DataFrame) -> DataFrame:
    cal = weekly_calendar.select(
        F.col("week").alias("forecast_week"), "is_holiday_week", "holiday_names", "season", "month"
    )
    return backtest.join(cal, "forecast_week", "left").withColumn(
        "abs_error", F.abs(F.col("actual") - F.col("candidate_forecast"))
    )


def holiday_fold_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold").agg(*_both([
        F.min("forecast_origin").alias("origin"), F.sum(F.coalesce("is_holiday_week", F.lit(0))).alias("holiday_weeks_in_val"),
        rnd(F.avg("actual"), 2).alias("mean_actual"), rnd(F.avg("candidate_forecast"), 2).alias("mean_forecast"),
    ])).select(
        "fold", "origin", F.col("n").alias("n_predictions"), rnd(F.col("_bw") * 100.0, 3).alias("baseline_wape_pct"),
        rnd(F.col("_cw") * 100.0, 3).alias("candidate_wape_pct"), rnd("_bias", 3).alias("candidate_bias"),
        "holiday_weeks_in_val", "mean_actual", "mean_forecast",
    )


def late_fold_elevation(rows: DataFrame, late=(3, 4)) -> DataFrame:
    inside = F.col("fold").isin(*late)
    a_in, a_out = F.avg(F.when(inside, F.col("actual"))), F.avg(F.when(~inside, F.col("actual")))
    b = F.col("candidate_forecast") - F.col("actual")
    return rows.agg(
        F.sum(F.when(inside, F.coalesce("is_holiday_week", F.lit(0)))).alias("late_holiday_weeks"),
        rnd(a_in, 2).alias("late_mean_demand"), rnd(a_out, 2).alias("other_mean_demand"),
        rnd(a_in / F.greatest(a_out, F.lit(0.01)), 3).alias("demand_elevation_ratio"),
        rnd(F.avg(F.when(inside, b)), 3).alias("late_bias"), rnd(F.avg(F.when(~inside, b)), 3).alias("other_bias"),
    )


def error_breakdown(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*_both([
        F.avg("actual").alias("_a"), F.avg("candidate_forecast").alias("_f"), F.avg("abs_error").alias("_e"),
    ])).select(
        *by, rnd("_a", 2).alias("mean_actual"), rnd("_f", 2).alias("mean_forecast"), rnd("_e", 2).alias("mean_abs_error"),
        rnd("_bias", 2).alias("bias"), rnd(F.col("_cw") * 100.0, 2).alias("wape_pct"),
    )


def holiday_period_detail(rows: DataFrame) -> DataFrame:
    return rows.groupBy("forecast_week", "is_holiday_week", "holiday_names", "season", "month").agg(
        rnd(F.sum("actual"), 1).alias("observed_demand"), rnd(F.sum("candidate_forecast"), 1).alias("forecast"),
        rnd(F.sum(F.col("candidate_forecast") - F.col("actual")), 1).alias("forecast_error"),
        F.count_if(F.col("abs_error") > F.col("actual") * 0.2).alias("affected_skus"),
    )


# ---- comparison and scoring -----------------------------------------------------
def error_tail(df: DataFrame, by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """P95 absolute error and accuracy on high demand (at or above P90)."""
    rows = finite(df, "actual", "prediction").withColumn("abs_err", F.abs(F.col("actual") - F.col("prediction")))
    cuts = quantile_table(rows, ["abs_err", "actual"], [0.9, 0.95], by)
    joined = rows.join(cuts, list(by))
    high = F.col("actual") >= F.col("actual_q0")
    return joined.groupBy(*by).agg(
        rnd(F.max("abs_err_q1"), 4).alias("p95_abs_error"), rnd(F.max("actual_q0"), 4).alias("high_demand_cut"),
        F.count_if(high).alias("n_high_demand"), rnd(F.avg(F.when(high, F.col("abs_err"))), 4).alias("high_demand_mae"),
        rnd(F.avg(F.when(F.col("actual") == 0, F.col("abs_err"))), 4).alias("zero_demand_mae"),
        rnd(F.avg(F.col("prediction") - F.col("actual")), 4).alias("bias"),
    )


def paired_comparison(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Both predictions on matched keys only."""
    pair = left.select(*keys, "actual", F.col("prediction").alias("_l")).join(
        right.select(*keys, F.col("prediction").alias("_r")), list(keys)
    )
    pair = finite(pair, "actual", "_l", "_r")
    lw, rw = wape(F.col("actual"), F.col("_l")) * 100.0, wape(F.col("actual"), F.col("_r")) * 100.0
    return pair.groupBy(*by).agg(
        F.count("*").alias("n_matched"), rnd(lw, 4).alias("left_wape"), rnd(rw, 4).alias("right_wape"),
        rnd(lw - rw, 4).alias("absolute_improvement"), rnd(ratio(lw - rw, lw) * 100.0, 4).alias("improvement_pct"),
    )


def classifier_metrics(df: DataFrame, thresholds: Sequence[float], by: Sequence[str], label="label", score="score") -> DataFrame:
    """Confusion-based rates for a threshold grid, in one aggregate."""
    rows = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    y, hit = F.col(label) == 1, F.col(score) >= F.col("threshold")
    table = rows.groupBy(*by, "threshold").agg(
        F.count("*").alias("n"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
        rnd(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))), 4).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: rnd(F.coalesce(c, F.lit(0.0)), 4)
    return table.withColumns({
        "actual_positive_rate": rnd(ratio(tp + fn, "n") * 100.0, 2), "predicted_positive_rate": rnd(ratio(tp + fp, "n") * 100.0, 2),
        "accuracy": rnd(ratio(tp + tn, "n"), 4), "precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)),
        "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)), "false_positive_demand_rate": rnd(ratio(fp, tn + fp) * 100.0, 2),
        "false_negative_demand_rate": rnd(ratio(fn, tp + fn) * 100.0, 2),
    })


def ranking_areas(df: DataFrame, by: Sequence[str], label="label", score="score") -> DataFrame:
    """ROC-AUC (average rank) and average precision over the scores as they are; equal scores are one step.

    Counts per distinct score are added up from the highest down, by ranges of scores (see ``scan``).
    """
    levels = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(stored(levels, "levels"), by, [F.desc("_s")], {"tp": "pos", "fp": "neg"})
    above = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return ranked.groupBy(*by).agg(
        rnd(ratio(above, F.max(F.col("tp_all").cast("double") * F.col("fp_all"))), 4).alias("roc_auc"),
        rnd(F.sum(ratio(F.col("pos") * F.col("tp").cast("double"), F.col("tp_all").cast("double") * (F.col("tp") + F.col("fp")))), 4).alias("pr_auc"),
    )


def hybrid_by_horizon(backtest: DataFrame) -> DataFrame:
    """Per horizon take the model with the lower error; candidate wins ties."""
    rule = horizon_table(backtest).select(
        "source_dataset", "horizon_step",
        F.when(F.col("candidate_wape") <= F.col("baseline_wape"), "candidate").otherwise("seasonal_naive").alias("selected_model"),
    )
    joined = backtest.join(F.broadcast(rule), ["source_dataset", "horizon_step"], "left")
    return joined.withColumn("selected_forecast", F.when(
        F.col("selected_model") == "candidate", F.coalesce("candidate_forecast", "seasonal_naive_forecast")
    ).otherwise(F.col("seasonal_naive_forecast")))


def champion(backtest: DataFrame) -> DataFrame:
    table = backtest.groupBy("source_dataset").agg(*_both())
    better = F.col("_cw") < F.col("_bw")
    return table.select(
        "source_dataset", F.when(better, "candidate").otherwise("seasonal_naive").alias("champion"),
        rnd(F.least("_cw", "_bw") * 100.0, 4).alias("champion_wape"), rnd((F.col("_bw") - F.col("_cw")) * 100.0, 4).alias("improvement_pp"),
    )


def select_with_override(metrics: DataFrame, incumbent: str, margin_pct: float, by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """Best validation model, unless the incumbent is within ``margin_pct`` of it."""
    best = leaderboard(metrics, by).where(F.col("rank") == 1).select(*by, F.col("model").alias("best"), F.col("wape").alias("best_wape"))
    held = metrics.where(F.col("model") == incumbent).select(*by, F.col("wape").alias("incumbent_wape"))
    gain = ratio(F.col("incumbent_wape") - F.col("best_wape"), "incumbent_wape") * 100.0
    return best.join(held, list(by), "left").withColumn("relative_gain_pct", rnd(gain, 4)).withColumn(
        "selected", F.when(F.col("incumbent_wape").isNotNull() & (gain < margin_pct), F.lit(incumbent)).otherwise(F.col("best"))
    )


def reproducibility(first: DataFrame, second: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    pair = first.select(*keys, F.col("prediction").alias("_a")).join(second.select(*keys, F.col("prediction").alias("_b")), list(keys), "outer")
    diff = F.max(F.abs(F.col("_a") - F.col("_b")))
    table = pair.groupBy(*by).agg(
        F.count("*").alias("sample_size"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("unmatched"),
        diff.alias("max_prediction_diff"),
    )
    d = F.col("max_prediction_diff")
    return table.withColumn("status", F.when((F.col("unmatched") == 0) & (d < 1e-6), "REPRODUCIBLE")
                            .when((F.col("unmatched") == 0) & (d < 1.0), "MINOR_NONDETERMINISM").otherwise("NOT_REPRODUCIBLE"))


def horizon_label(step: Column, supported: int = SUPPORTED_HORIZON_WEEKS) -> Column:
    return F.when(step <= supported, "PRODUCTION").otherwise("EXTENDED_PARTIAL")
