"""Operator rules on small frames, against plain Python."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.operators import backtest, baselines, bi, cleaning, features, metrics, monitoring, quality, risk, scenarios
from demandloom.sources.retail import Retail

D0 = dt.date(2020, 1, 6)


def day(n):
    return D0 + dt.timedelta(days=n)


def test_transaction_type_precedence(spark):
    rows = [("C1", -1.0, -2.0), ("A1", -1.0, 5.0), ("1", -1.0, -2.0), ("2", 1.0, -2.0), ("3", 1.0, 0.0), ("4", -1.0, 1.0)]
    df = spark.createDataFrame(rows, "invoice string, quantity double, price double").withColumn("t", cleaning.transaction_type())
    assert [r.t for r in df.collect()] == ["CANCELLATION", "INVALID", "RETURN", "INVALID", "SALE", "RETURN"]


def test_description_recovery(spark):
    rows = [("1", " red "), ("1", "red"), ("1", "blue"), ("1", None), ("1", "  "), ("2", None)]
    df = spark.createDataFrame(rows, "stock_code string, description string")
    got = sorted((r.stock_code, r.description, r.description_source) for r in cleaning.recover_descriptions(df).collect())
    assert got == [("1", "blue", "original"), ("1", "red", "original"), ("1", "red", "original"), ("1", "red", "recovered"), ("1", "red", "recovered"),
                   ("2", "Unknown Product", "unknown")]


def test_zero_fill_matches_full_grid(spark):
    rng = random.Random(1)
    rows = [(k, day(7 * i), rng.randint(1, 9)) for k in "abc" for i in range(20) if rng.random() < 0.3]
    df = spark.createDataFrame(rows, "k string, date date, y int")
    span = spark.createDataFrame([(D0, day(7 * 19))], "lo date, hi date")
    got = {(r.k, r.date): r.y for r in baselines.zero_fill(df, ["k"], "date", span, 7, ["y"]).collect()}
    held = {(k, d): y for k, d, y in rows}
    assert got == {(k, day(7 * i)): held.get((k, day(7 * i)), 0) for k in {k for k, _, _ in rows} for i in range(20)}


def test_trailing_features_never_see_the_current_row(spark):
    rows = [("S", "e", "p", day(i), float(2**i)) for i in range(9)]
    df = spark.createDataFrame(rows, "source_dataset string, entity_id string, product_key string, date date, units_sold double")
    made = df.withColumns(features.rolling(features.GRAIN, "units_sold", (3,), "date", ("mean", "std")))
    got = made.orderBy("date").toPandas()
    want = got["units_sold"].shift(1).rolling(3, min_periods=1)
    np.testing.assert_allclose(got["rolling_mean_3"].astype(float), want.mean())
    np.testing.assert_allclose(got["rolling_std_3"].astype(float), want.std())
    checks = quality.leakage_checks(df.withColumns({**features.lags(features.GRAIN, "units_sold", (1, 2), "date", "units_sold_lag_"), "rolling_mean_3": F.col("units_sold")}),
                                    features.GRAIN, (1, 2), (3,))
    found = {r.check: r.violations for r in checks.collect()}
    assert found["lag_1_mismatch"] == 0 and found["lag_2_mismatch"] == 0 and found["rolling_mean_3_mismatch"] == 9


def test_rolling_origin_backtest_against_plain_loops(spark):
    rng = random.Random(5)
    weeks = [day(7 * i) for i in range(80)]
    rows = [("S", k, w, rng.randint(1, 50)) for k in "abc" for w in weeks if k == "a" or rng.random() < 0.7]
    df = spark.createDataFrame(rows, "source_dataset string, product_key string, week date, units_sold long")
    got = {(r.product_key, r.fold, r.forecast_week): (r.horizon_step, r.seasonal_naive_forecast, r.candidate_forecast) for r in backtest.rolling_origin(df).collect()}
    want = {}
    for fold, origin in enumerate(range(80 - 8 - 4, 80 - 8 + 1)):
        for k in "abc":
            train = [y for _, p, w, y in rows if p == k and w <= weeks[origin]]
            test = [(w, y) for _, p, w, y in rows if p == k and w in weeks[origin + 1:origin + 9]]
            if len(train) < 13:
                continue
            for i, (w, _) in enumerate(test):
                at = len(train) - 52 + i
                want[(k, fold, w)] = (i + 1, float(train[at] if at >= 0 else train[-1]), float(np.mean(train[-4:])))
    assert got == want


def test_metrics_on_known_values(spark):
    rows = [("a", 0.0, 0.0), ("a", 4.0, 2.0), ("a", 6.0, 9.0), ("b", 0.0, 0.0), ("c", 1.0, None), ("c", 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, actual double, prediction double")
    got = {r.g: r for r in metrics.accuracy(df, ["g"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].mae, got["a"].wape, got["a"].n) == (1.6667, 50.0, 3)
    assert got["a"].mape == 50.0 and got["a"].smape == 35.5556
    assert (got["b"].wape, got["b"].mape, got["b"].smape) == (0.0, None, 0.0)


def test_running_share_matches_sorted_cumulation(spark):
    rng = random.Random(2)
    rows = [("S", f"p{i}", float(rng.choice([5, 5, rng.random() * 1000]))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = metrics.running_share(df, ["g"], "v", "k").toPandas().sort_values("rank")
    want = pd.DataFrame(rows, columns=["g", "k", "v"]).sort_values(["v", "k"], ascending=[False, True])
    assert got["k"].tolist() == want["k"].tolist() and got["rank"].tolist() == list(range(1, 501))
    np.testing.assert_allclose(got["cumulative_share"], want["v"].cumsum() / want["v"].sum())


def plain_psi(e, a, bins=10):
    edges = np.unique(np.quantile(e, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        return 0.0
    h = [np.histogram(x, bins=edges)[0] for x in (e, a)]
    p, q = (np.clip(x / max(x.sum(), 1), 1e-6, None) for x in h)
    return float(np.sum((q - p) * np.log(q / p)))


def plain_ks(e, a):
    grid = np.unique(np.concatenate([e, a]))
    return max(abs(np.mean(e <= x) - np.mean(a <= x)) for x in grid)


def test_psi_and_ks_match_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"shift": (rng.normal(0, 1, 400), rng.normal(1, 1, 300)), "zeros": (np.r_[np.zeros(300), rng.random(100)], rng.random(90)), "flat": (np.ones(50), rng.random(60)),
              "few": (rng.random(19), rng.random(50))}
    frame = lambda i: spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v[i]], "g string, v double")
    got = {r.g: r.psi for r in monitoring.psi(frame(0), frame(1), ["g"], "v").collect()}
    dist = {r.g: r.ks for r in monitoring.ks(frame(0), frame(1), ["g"], "v").collect()}
    for g in ("shift", "zeros", "flat"):
        assert got[g] == pytest.approx(plain_psi(*groups[g]), abs=1e-9)
        assert dist[g] == pytest.approx(plain_ks(*groups[g]))
    assert got["few"] is None and dist["few"] is None


def test_status_and_drift_classes(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.2, 0.3, None)], "p double")
    assert [r[0] for r in df.select(monitoring.classify_psi(F.col("p"))).collect()] == ["STABLE", "WATCH", "DRIFT", "CRITICAL_DRIFT", "INSUFFICIENT_DATA"]
    comp = lambda *s: spark.createDataFrame([("c", x) for x in s], "component string, status string")
    score = lambda *s: monitoring.health(comp(*s)).first().health_score
    assert [score("PASS"), score("WARNING"), score("WARNING", "PARTIAL"), score("FAIL", "PASS")] == ["HEALTHY", "WATCH", "DEGRADED", "CRITICAL"]


def test_stress_scenarios(spark):
    rows = risk.check_scenarios(risk.scenario_rows(spark)).collect()
    assert len(rows) == 6 and all(r["pass"] for r in rows)


def test_inconsistent_risk_row_is_reported(spark):
    df = spark.createDataFrame(
        [("HEALTHY", "CRITICAL", "OPTIMAL", 0, 100.0, 0.0, -500.0, None, None)],
        "recommended_action string, stockout_risk_level string, overstock_risk_level string, on_hand_units int, forecast_weekly_demand double, weeks_of_supply double, projected_balance double, sales_at_risk double, locked_capital double")
    row = risk.consistency(df).first()
    assert row.consistency_status == "FAIL" and row.healthy_elevated_stockout == 1 and row.healthy_negative_balance == 1


def test_growth_classes(spark):
    rows = [(0.04, 10, 10), (0.05, 10, 10), (-0.05, 10, 10), (0.5, 9, 10), (None, 10, 10), (0.5, None, 10)]
    df = spark.createDataFrame(rows, "r double, h int, n int")
    got = [r[0] for r in df.select(bi.growth_class(F.col("r"), F.col("h"), F.col("n"))).collect()]
    assert got == ["Stable", "Growing", "Declining", *["Insufficient Evidence"] * 3]


def test_optional_filters_skip_absent_columns(spark):
    df = spark.createDataFrame([("S", "1", D0), ("U", "1", D0)], "source_dataset string, store_id string, date date")
    assert bi.select_rows(df, dataset="S", entity="1", horizon=3, start="2020-01-01").count() == 1


def test_record_validation_reasons(spark):
    ok = {"units_sold_lag_1": "3"}
    rows = [("e", "p", D0, ok), ("e", "q", D0, {**ok, "model_path": "x"}), ("e", "r", D0, {**ok, "revenue": "1"}), ("e", "s", D0, {**ok, "x": " NaN "}), ("e", "t", D0, {"units_sold_lag_1": "-1"}),
            ("e", "u", D0, {"x": "1"}), ("../e", "v", D0, ok), ("e", "w", None, ok), ("e", "x", D0, ok), ("e", "x", D0, ok), ("e", "y", D0, {**ok, "x": "[1]"}), ("e\0", "za", D0, ok), ("a/Models\\Final/b", "zb", D0, ok), ("e", "zc", D0, {**ok, "hcal_month": None}), ("e", "zd", D0, {**ok, "hcal_month": "4"})]
    df = spark.createDataFrame(rows, "entity_id string, product_key string, date date, features map<string,string>")
    got = sorted((r.product_key, r.reason) for r in quality.validate_records(df, ["entity_id", "product_key", "date"]).collect())
    assert got == [("p", None), ("q", "forbidden_field"), ("r", "leakage_column"), ("s", "non_finite_value"), ("t", "negative_value"), ("u", "missing_lag_1"), ("v", "invalid_key"),
                   ("w", "invalid_date"), ("x", "duplicate_key"), ("x", "duplicate_key"), ("y", "nested_value"), ("za", "invalid_key"), ("zb", "invalid_key"), ("zc", "missing_calendar"), ("zd", None)]


def test_scenario_path_feeds_predictions_back(spark):
    rows = [("a", day(i), float(v), 0.0, 0) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])]
    hist = spark.createDataFrame(rows, "k string, date date, units_sold double, discount_pct double, promotion_flag int")
    got = scenarios.scenario(hist, 3, ["k"], scenarios.mean_of_last(2), surge=2.0).orderBy("step").collect()
    buf, want = [1, 2, 3, 4, 5, 6, 7, 8], []
    for i in range(3):
        value = float(np.mean(buf[-2:])) * 2
        spread = max(1.0, float(np.std(buf[-7:])) * np.sqrt(1 + i / 10))
        want.append((round(value, 2), round(max(0.0, value - 1.96 * spread), 2), round(value + 1.96 * spread, 2)))
        buf.append(value)
    np.testing.assert_allclose([(r.forecast_units, r.forecast_lower, r.forecast_upper) for r in got], want)
    assert [r.date for r in got] == [day(8), day(9), day(10)]


@pytest.mark.parametrize("scores", ["small", "tied", "mixed"])
def test_ranking_areas_of_scores_as_they_are(spark, scores):
    rng = np.random.default_rng(3)
    label = (rng.random(800) < 0.2).astype(int)
    score = {"small": rng.random(800) * 1e-9 + label * 2e-10, "tied": np.full(800, 0.3), "mixed": np.round(rng.random(800) + 0.3 * label, 2)}[scores]
    df = spark.createDataFrame([("a", int(y), float(x)) for y, x in zip(label, score)] + [("b", 1, 0.5)], "g string, label int, score double")
    got = {r.g: r for r in metrics.ranking_areas(df, ["g"]).collect()}
    pos, neg = score[label == 1], score[label == 0]
    area = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    precision = sum((np.sum(pos == s) / len(pos)) * (np.sum(pos >= s) / np.sum(score >= s)) for s in np.unique(pos))
    assert got["a"].roc_auc == pytest.approx(area, abs=1e-4) and got["a"].pr_auc == pytest.approx(precision, abs=1e-4)
    assert got["b"].roc_auc is None and got["b"].pr_auc == 1.0


def test_distinct_counts_send_a_line_once(spark, capsys):
    from demandloom.functions.semantics import distinct_of, with_ordinals
    from demandloom.operators import star

    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", None, "x"), (None, 2, None), (None, 3, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, n int, c string")
    made = with_ordinals(df, ["k"], ["n", "c"]).groupBy("k").agg(distinct_of("n").alias("n"), distinct_of("c").alias("c"))
    assert {tuple(r) for r in made.collect()} == {("a", 1, 2), (None, 2, 0), ("b", 0, 0)}
    lines = spark.createDataFrame(
        [(dt.date(2020, 1, 1), "1", "p", 2.0, 3.0, 7, "SALE")], "invoice_date_only date, invoice string, stock_code string, quantity double, price double, customer_id long, transaction_type string")
    star.online_sales(lines).explain()
    plan = capsys.readouterr().out
    assert "Expand" not in plan and plan.count("Exchange") == 1


def _sales_tables(spark, folder):
    """A few lines of three series: sales on a week end, on the first and last day, on a day without a store, and two series without any."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    rows = [(day, part, store, units) for day, part, store, units in (
        ("1996-01-03", 1, 1, 5.0), ("1996-01-08", 1, 1, 2.0), ("1996-01-09", 1, 1, 7.0), ("1996-02-21", 1, 1, 3.0), ("1996-01-20", 2, 1, 90.0),
        ("1996-01-20", 2, 1, 1.0), ("1996-01-15", 1, 2, None), ("1996-01-16", 1, None, 4.0), (None, 2, 2, 6.0), ("1996-02-21", 2, 3, 1.0))]
    made = [(i, part, store, units, 10.0, 0.0, day and dt.datetime.fromisoformat(day)) for i, (day, part, store, units) in enumerate(rows)]
    spark.createDataFrame(made, line).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#11"), (2, "Brand#12")], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    return rows


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inventory_snapshots_are_sales_days_and_week_ends(spark, tmp_path):
    rows = _sales_tables(spark, tmp_path)
    expect, lo, hi = {}, dt.date(1996, 1, 2), dt.date(1996, 2, 21)  # weeks start on Tuesdays
    for day, part, store, units in rows:
        key = (store and f"STORE_{store}", f"SKU_{part + 10}")
        at = expect.setdefault(key, {})
        for k in range(8):
            at.setdefault(min(lo + dt.timedelta(7 * k + 6), hi), 0)
        day = day and dt.date.fromisoformat(day)
        at[day] = units if day not in at else (at[day] or 0) + (units or 0)
    snapshots = Retail(spark, str(tmp_path)).inventory_snapshots
    got = [(r.store_id, r.sku_id, r.date, r.units_sold) for r in snapshots.collect()]
    want = [(*key, day, units) for key, at in expect.items() for day, units in at.items()]
    assert sorted(got, key=str) == sorted([(a, b, d, u if u is None else int(u)) for a, b, d, u in want], key=str)
    # the sales are dealt by series; snapshots, far more rows, are not
    counted = snapshots.groupBy("sku_id", "store_id").count()
    assert _planned(counted).count("Exchange hashpartitioning") == 1


def test_inventory_rules_match_a_join(spark):
    columns = "date date, store_id string, sku_id string, units_sold long"
    rows = [(f"1996-01-0{d}", s, k, u) for d, s, k, u in ((1, "a", "x", 1), (1, "a", "x", 2), (2, "a", "x", 3), (3, "a", "y", None), (4, None, "x", 4), (5, "b", "x", 5))]
    typed = [F.col("date").cast("date").alias("date"), "store_id", "sku_id", "units_sold"]
    text = columns.replace("date date", "date string")
    sales = spark.createDataFrame([*rows, (None, "a", "x", 9), ("1996-01-05", "b", "x", None), ("1996-01-05", "b", "x", 6)], text).select(*typed)
    snapshots = spark.createDataFrame([*rows, (None, "a", "x", 9), ("1996-01-09", "a", "x", 8)], text).select(*typed).withColumns({
        "beginning_inventory": F.lit(10).cast("long"), "receipts": F.col("units_sold") % 2, "stockout_flag": F.col("units_sold") % 4, "ending_inventory": 10 - F.col("units_sold")})
    pair = snapshots.join(sales.withColumnRenamed("units_sold", "_sold"), ["date", "store_id", "sku_id"], "left")
    want = pair.agg(F.count("*"), F.count_if(~F.col("stockout_flag").isin(0, 1)), F.count_if(10 + F.col("receipts") - F.col("units_sold") != F.col("ending_inventory")),
                    F.count("_sold"), F.count_if(F.col("_sold") != F.col("units_sold"))).first()
    got = quality.inventory_rules(snapshots, sales).first()
    assert tuple(want) == (got.original_rows, got.invalid_stockout_flags, got.canonical_equation_mismatch_rows, got.cross_checked_rows, got.cross_sales_mismatch_rows)
    none = quality.inventory_rules(snapshots.limit(0), sales).first()
    assert none.original_rows == 0 and none.cross_checked_rows == 0


def test_windows_over_the_panel_need_no_shuffle(spark, sf):
    panel = Retail(spark, sf).panel
    lagged = panel.withColumn("before", baselines.seasonal_naive(features.series(features.GRAIN)))
    assert len(re.findall(r"Exchange hashpartitioning\(source_dataset#\d+, entity_id#", _planned(lagged))) == 1
    series = panel.where("source_dataset = 'SYNTHETIC'").groupBy(*features.GRAIN).agg(F.count("*").alias("n"), F.count_distinct("date").alias("d"), F.min("date").alias("lo"))
    assert series.select("n", "d", "lo").distinct().count() == 1  # as many weeks in each, from the same one on
