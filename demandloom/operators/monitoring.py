"""Data-quality, drift, accuracy and health monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.quantiles import exact_quantiles, quantiles_of_counts
from demandloom.functions.scan import running_totals
from demandloom.functions.semantics import ratio, rnd, to_long
from demandloom.functions.vocabulary import (
    MONITORING, PSI_DRIFT, PSI_STABLE, PSI_WATCH, SUPPORTED_HORIZON_WEEKS, SYNTHETIC, WAPE_BASELINE,
)
from demandloom.operators.metrics import horizon_label, wape
from demandloom.session import stored

MIN_SAMPLE = 20


def distribution(df: DataFrame, by: Sequence[str] = ("source_dataset", "horizon")) -> DataFrame:
    p, a = F.col("prediction"), F.col("actual")
    share = lambda c: rnd(F.avg(c.cast("double")) * 100.0, 4)
    table = df.groupBy(*by).agg(
        F.count("*").alias("n"), rnd(F.avg(p), 6).alias("prediction_mean"),
        rnd(F.coalesce(F.stddev_samp(p), F.lit(0.0)), 6).alias("prediction_std"), rnd(F.min(p), 6).alias("prediction_min"),
        rnd(F.max(p), 6).alias("prediction_max"), share(p == 0).alias("zero_prediction_rate_pct"),
        rnd(F.avg(F.when(a == 0, (p > 0).cast("double"))) * 100.0, 4).alias("zero_false_positive_rate_pct"),
    )
    median = exact_quantiles(df, "prediction", [0.5], by, ["_m"])
    return table.join(median.select(*by, rnd("_m", 6).alias("prediction_median")), list(by), "left")


def two_sided_counts(expected: DataFrame, actual: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows of each side per distinct value, written once.

    Moments, PSI and KS all follow from this table, so the two inputs are read
    once and repeated values are merged before any further shuffle.
    """
    side = lambda df, e, a: df.select(*by, F.col(value).cast("double").alias("_v"), F.lit(e).alias("e"), F.lit(a).alias("a"))
    both = side(expected, 1, 0).unionByName(side(actual, 0, 1)).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return stored(both.groupBy(*by, "_v").agg(F.sum("e").alias("e"), F.sum("a").alias("a")), "value-counts")


def counts_of_sides(df: DataFrame, by: Sequence[str], value: str, expected: Column, actual: Column) -> DataFrame:
    """``two_sided_counts`` of two parts of one table, read once; a row may be in both or in neither."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), F.coalesce(expected, F.lit(False)).alias("_e"), F.coalesce(actual, F.lit(False)).alias("_a"))
    rows = rows.where((F.col("_e") | F.col("_a")) & F.col("_v").isNotNull() & ~F.isnan("_v"))
    return stored(rows.groupBy(*by, "_v").agg(F.count_if("_e").alias("e"), F.count_if("_a").alias("a")), "value-counts")


def psi(expected: DataFrame, actual: DataFrame, by: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Population stability index per group over baseline decile edges."""
    return psi_of_counts(two_sided_counts(expected, actual, by, value), by, bins)


def psi_of_counts(counts: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Repeated edges are dropped, values outside the baseline range are left out
    and shares are floored at 1e-6."""
    by = list(by)
    names = [f"_e{i}" for i in range(bins + 1)]
    base = counts.where(F.col("e") > 0).select(*by, "_v", F.col("e").alias("_c"))
    cuts = quantiles_of_counts(base, [i / bins for i in range(bins + 1)], by, names).select(
        *by, F.col("n").alias("n_expected"), F.array_distinct(F.array(*names)).alias("_edges")
    )
    tagged = counts.join(cuts, by)
    inside = (F.col("_v") >= F.element_at("_edges", 1)) & (F.col("_v") <= F.element_at("_edges", -1))
    # left-closed bins, the last one closed on both sides
    bucket = F.least(F.size(F.filter("_edges", lambda e: e <= F.col("_v"))), F.size("_edges") - 1)
    hist = tagged.groupBy(*by, F.when(inside, bucket).alias("_b")).agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.max("n_expected").alias("n_expected"), F.max(F.size("_edges")).alias("_k"),
    )
    kept = F.col("_b").isNotNull()
    # at most bins + 1 histogram rows per group
    filled = hist.groupBy(*by).agg(
        F.max("n_expected").alias("n_expected"), F.max("_k").alias("_k"), F.sum("a").alias("n_actual"),
        F.sum(F.when(kept, F.col("e"))).alias("_in_e"), F.sum(F.when(kept, F.col("a"))).alias("_in_a"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("_b", "e", "a")))).alias("_h"),
    )
    floor = F.lit(1e-6)
    pe = lambda x: F.greatest(x["e"] / F.greatest(F.col("_in_e"), F.lit(1)), floor)
    pa = lambda x: F.greatest(x["a"] / F.greatest(F.col("_in_a"), F.lit(1)), floor)
    # a bin empty on both sides adds nothing, so absent bins can stay absent
    total = F.aggregate("_h", F.lit(0.0), lambda acc, x: acc + (pa(x) - pe(x)) * F.log(pa(x) / pe(x)))
    enough = (F.col("n_expected") >= MIN_SAMPLE) & (F.col("n_actual") >= MIN_SAMPLE)
    return filled.select(
        *by, "n_expected", "n_actual", F.when(enough, F.when(F.col("_k") < 3, 0.0).otherwise(total)).alias("psi")
    )


def classify_psi(value: Column) -> Column:
    return (
        F.when(value.isNull(), "INSUFFICIENT_DATA").when(value < PSI_STABLE, "STABLE").when(value < PSI_WATCH, "WATCH")
        .when(value < PSI_DRIFT, "DRIFT").otherwise("CRITICAL_DRIFT")
    )


def ks(expected: DataFrame, actual: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group."""
    return ks_of_counts(two_sided_counts(expected, actual, by, value), by)


def ks_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest gap between the running shares of both sides (see ``scan``). ``counts`` is read several times: pass a stored table."""
    steps = running_totals(counts, by, ["_v"], {"_ce": "e", "_ca": "a"})
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col(f"{c}_all").cast("double"))
    usable = (F.col("_ce_all") >= MIN_SAMPLE) & (F.col("_ca_all") >= MIN_SAMPLE)
    return steps.groupBy(*by).agg(F.max(F.when(usable, F.abs(share("_ce") - share("_ca")))).alias("ks"))


def moments_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of both sides, deviations taken from the mean."""
    by = list(by)
    v = F.col("_v")
    mean = lambda c: ratio(F.sum(v * F.col(c)), F.sum(c))
    means = counts.groupBy(*by).agg(mean("e").alias("_me"), mean("a").alias("_ma"))
    rows = counts.join(means, by)
    std = lambda c, m: F.sqrt(ratio(F.sum(F.col(c) * (v - F.col(m)) * (v - F.col(m))), F.sum(c) - 1))
    return rows.groupBy(*by).agg(
        rnd(F.max("_me"), 4).alias("ref_mean"), rnd(std("e", "_me"), 4).alias("ref_std"), rnd(F.max("_ma"), 4).alias("cur_mean"), rnd(std("a", "_ma"), 4).alias("cur_std"),
    )


def drift_table(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Moments, PSI and KS of every feature in reference and current rows."""
    long = lambda df: to_long(df.select(*[F.col(f).cast("double").alias(f) for f in features]), [], features, "feature", "value")
    counts = two_sided_counts(long(reference), long(current), ["feature"], "value")
    return (
        moments_of_counts(counts, ["feature"])
        .join(psi_of_counts(counts, ["feature"]).select("feature", rnd("psi", 4).alias("psi")), "feature", "left")
        .join(ks_of_counts(counts, ["feature"]).select("feature", rnd("ks", 4).alias("ks")), "feature", "left")
    )


def weekly_windows(weekly: DataFrame) -> DataFrame:
    """Baseline (first 70 %) and current (last fifth) weeks; a week may be both."""
    order = Window.orderBy("week")
    weeks = weekly.select("week").distinct().withColumns({
        "i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy()),
    })
    return weeks.select(
        "week", (F.col("i") <= F.floor(F.col("n") * F.lit(0.7))).alias("is_baseline"),
        (F.col("i") > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 5))).alias("is_current"),
    )


def data_drift(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = features.join(F.broadcast(weekly_windows(features)), "week")
    long = lambda keep: to_long(
        rows.where(keep).select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns, "feature", "value"
    )
    table = psi(long("is_baseline"), long("is_current"), ["feature"], "value")
    return table.select("feature", "n_expected", "n_actual", rnd("psi", 4).alias("psi"), classify_psi(F.col("psi")).alias("status"))


def drift_status(table: DataFrame) -> DataFrame:
    critical, drift = F.count_if(F.col("status") == "CRITICAL_DRIFT"), F.count_if(F.col("status") == "DRIFT")
    return table.agg(
        F.count("*").alias("features"), critical.alias("n_critical"), drift.alias("n_drift"),
        F.when(critical >= 3, "FAIL").when((critical >= 1) | (drift >= 5), "WARNING").otherwise("PASS").alias("overall_status"),
    )


def prediction_drift(current: DataFrame, baseline: DataFrame, column: str = "prediction", baseline_column: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Level, spread and quartiles of the newest predictions beside those before, per group, with the shifts found."""
    by = list(by)
    keys = by or ["_all"]
    whole = lambda df, c: df.select(*[F.col(k) for k in by], *([] if by else [F.lit(1).alias("_all")]), F.col(c).cast("double").alias("p"))
    rows = stored(whole(current, column), "predictions")
    p = F.col("p")
    now = rows.groupBy(*keys).agg(F.avg(p).alias("m"), F.stddev_samp(p).alias("s"), (F.avg((p == 0).cast("double")) * 100.0).alias("z"))
    quarters = exact_quantiles(rows, "p", [0.25, 0.5, 0.75], keys, ["p25", "median", "p75"]).drop("n")
    then = whole(baseline, baseline_column).groupBy(*keys).agg(F.avg(p).alias("bm"), F.stddev_samp(p).alias("bs"))
    row = now.join(then, keys, "left").join(quarters, keys, "left")
    mean, std, bm, bs = rnd("m", 4), rnd("s", 4), rnd("bm", 4), rnd("bs", 4)
    shift = ratio(mean - bm, bm)
    flags = F.array_compact(F.array(
        F.when((bm > 0) & (F.abs(shift) > 0.3), "mean_shift"),
        F.when((bs > 0) & (ratio(std, bs) > 2), "variance_explosion"),
        F.when(F.col("z") > 50, "excessive_zero_forecasts"),
    ))
    return row.select(
        *by, mean.alias("mean"), rnd("median", 4).alias("median"), std.alias("std"), rnd("z", 2).alias("zero_rate_pct"), rnd("p25", 4).alias("p25"), rnd("p75", 4).alias("p75"),
        bm.alias("baseline_mean"), bs.alias("baseline_std"), rnd(F.when(bm > 0, shift) * 100.0, 1).alias("mean_shift_pct"),
        F.array_join(flags, ",").alias("shifts"), F.when(F.size(flags) > 0, "WARNING").otherwise("PASS").alias("overall_status"),
    )


def forecast_performance(backtest: DataFrame, baseline: float = WAPE_BASELINE) -> DataFrame:
    """Measured errors per horizon and overall (horizon NULL) with a status."""
    y, f = F.col("actual"), F.col("candidate_forecast")
    cols = [rnd(wape(y, f) * 100.0, 4).alias("wape_pct"), rnd(F.avg(f - y), 4).alias("bias"), F.count("*").alias("n")]
    by_h = backtest.groupBy(F.col("horizon_step").alias("horizon")).agg(*cols).withColumn("label", horizon_label(F.col("horizon")))
    supported = backtest.where(F.col("horizon_step") <= SUPPORTED_HORIZON_WEEKS).agg(*cols).withColumn("label", F.lit("SUPPORTED"))
    overall = backtest.agg(*cols).withColumn("label", F.lit("OVERALL"))
    w = F.col("wape_pct")
    status = F.when(F.col("label") != "OVERALL", "MEASURED").when(w > baseline * 1.3, "FAIL").when(w > baseline * 1.15, "WARNING").otherwise("MEASURED")
    return by_h.unionByName(supported, True).unionByName(overall, True).withColumn("status", status)


def holiday_performance(backtest: DataFrame, weekly_calendar: DataFrame) -> DataFrame:
    """Holiday weeks against the rest, from one conditional aggregate."""
    weeks = weekly_calendar.where(F.col("is_holiday_week") == 1).select(F.col("week").alias("forecast_week"), F.lit(True).alias("_h"))
    rows = backtest.join(F.broadcast(weeks), "forecast_week", "left").withColumn("_h", F.coalesce("_h", F.lit(False)))
    y, f, h = F.col("actual"), F.col("candidate_forecast"), F.col("_h")
    part = lambda keep: ratio(F.sum(F.when(keep, F.abs(y - f))), F.sum(F.when(keep, F.abs(y)))) * 100.0
    table = rows.agg(
        F.count_if(h).alias("holiday_rows"), rnd(part(h), 4).alias("holiday_wape_pct"), rnd(part(~h), 4).alias("non_holiday_wape_pct"),
        rnd(F.avg(F.when(h, f - y)), 4).alias("holiday_bias"), rnd(F.avg(F.when(~h, f - y)), 4).alias("non_holiday_bias"),
    )
    raised = F.col("holiday_wape_pct") > F.col("non_holiday_wape_pct") * 1.3
    return table.withColumn("status", F.when(raised, "WARNING").otherwise("PASS"))


def alerts(accuracy: DataFrame, dist: DataFrame, quality: DataFrame, drift: DataFrame) -> DataFrame:
    """Threshold alerts from one-row-per-group tables, duplicates removed."""
    cfg = MONITORING
    src, h, w = F.col("source_dataset"), F.col("horizon"), F.col("wape")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.format_string("%.4f", F.col(c))
    rule = lambda df, cond, code, detail: df.where(cond).select(F.lit(code).alias("code"), F.lit("warning").alias("severity"), detail.alias("detail"))
    syn1 = (src == SYNTHETIC) & (h == 1)
    zero = F.col("zero_prediction_rate_pct")
    found = [
        rule(quality, F.col("n_duplicates") > 0, "data_quality_degradation", text("duplicate_rate_pct=", num("duplicate_rate_pct"))),
        rule(dist, syn1 & ((zero < cfg["synthetic_zero_pred_rate_min"]) | (zero > cfg["synthetic_zero_pred_rate_max"])),
             "forecast_distribution_drift", text("SYNTHETIC zero-prediction rate ", num("zero_prediction_rate_pct"), " outside 50.0-75.0")),
        rule(dist, syn1 & (F.col("zero_false_positive_rate_pct") > cfg["synthetic_zero_fp_warn"]),
             "zero_demand_false_positive_increase", text("P(pred>0|actual=0)=", num("zero_false_positive_rate_pct"), " > 10.0")),
        rule(accuracy, (src == "UCI") & (h == 1) & (w > cfg["uci_h1_wape_fold2"]), "accuracy_degradation", text("UCI h=1 WAPE ", num("wape"), " > 105.0")),
        rule(accuracy, (src == "UCI") & (h == 1) & (w > cfg["uci_h1_wape_1p5x"]), "accuracy_degradation", text("UCI h=1 WAPE ", num("wape"), " > 119.2")),
        rule(accuracy, syn1 & (w > cfg["synthetic_h1_wape_1p5x"]), "accuracy_degradation", text("SYNTHETIC h=1 WAPE ", num("wape"), " > 39.4")),
        rule(drift, F.col("psi") > cfg["psi_warn"], "feature_drift", text(F.col("feature"), " PSI=", num("psi"), " > 0.2")),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["code", "detail"])


# What to do about a failing component.
ACTIONS = {
    "data_quality": "Review data ingestion pipeline",
    "feature_quality": "Review feature pipeline",
    "data_drift": "Investigate drift in input features",
    "prediction_drift": "Investigate forecast distribution shift",
    "forecast_performance": "Review forecast performance vs baseline",
    "risk_consistency": "Investigate inventory inputs and risk logic",
    "model_integrity": "Investigate model integrity immediately",
}


def component_alerts(components: DataFrame) -> DataFrame:
    """CRITICAL or WARNING rows from (component, status)."""
    action = F.lit("Review monitoring evidence")
    for name, what in ACTIONS.items():
        action = F.when(F.col("component") == name, what).otherwise(action)
    severity = F.when(F.col("status") == "FAIL", "CRITICAL").when(F.col("status") == "WARNING", "WARNING")
    return components.select("component", severity.alias("severity"), action.alias("recommended_action")).where(F.col("severity").isNotNull())


def health(components: DataFrame) -> DataFrame:
    fails = F.count_if(F.col("status") == "FAIL")
    warns = F.count_if(F.col("status").isin("WARNING", "PARTIAL"))
    return components.agg(
        F.count("*").alias("components"), fails.alias("n_fail"), warns.alias("n_warning"),
        F.when(fails > 0, "CRITICAL").when(warns >= 2, "DEGRADED").when(warns >= 1, "WATCH").otherwise("HEALTHY").alias("health_score"),
    )


def compare_manifests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two (path, size, sha256) listings."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "outer")
    state = (
        F.when(F.col("a.path").isNull(), "ADDED").when(F.col("b.path").isNull(), "REMOVED")
        .when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.size") != F.col("b.size")), "CHANGED").otherwise("SAME")
    )
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))
