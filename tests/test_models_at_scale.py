"""Fits that share what is the same, side by side."""

import datetime as dt
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from demandloom.functions.recurrences import add_past_ewm
from demandloom.operators import ml
from demandloom.session import shared_dir, stored


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(900):
        x, c = rng.random(), rng.choice("abc")
        split = "train" if i < 600 else "validation" if i < 750 else "test"
        made.append(("S", f"p{i % 5}", dt.date(2020, 1, 7) + dt.timedelta(days=7 * (i // 5)), split, x, rng.random() if i % 7 else None, c, 20 * x + "abc".index(c) * 3 + rng.random()))
    return stored(spark.createDataFrame(made, "source_dataset string, product_key string, week date, split string, x double, y double, c string, units_sold double").coalesce(1), "rows")  # one file: subsamples are drawn by partition


def kept(spark, name):
    top = f"{shared_dir(spark)}/stages"
    return len([x for x in os.listdir(top) if x.startswith(f"{name}-")]) if os.path.isdir(top) else 0


def test_candidates_share_their_preparation_and_equal_fits_alone(spark, rows):
    models = {"linear": ml.candidates()["linear"], "poisson": ml.candidates()["poisson"], "gradient_boosting": ml.boosted(4, 3)}
    before = kept(spark, "levels")
    table, fitted = ml.train_and_compare(rows, ["x", "y"], models, ["c"])
    assert kept(spark, "levels") == before + 1  # was one for each candidate
    got = {(r.model, r.split): r.mae for r in table.collect()}
    known = stored(ml.with_indicators(rows, ["x", "y"]), "known")
    for name, estimator in models.items():
        alone = ml.score(ml.fit(known.where("split = 'train'"), ["x", "y"], estimator, ["c"]), known.where("split <> 'train'"))
        want = {r.split: r.mae for r in ml.metrics.accuracy(alone, ["split"], "label", "prediction").collect()}
        assert {s: got[name, s] for s in want} == want
        assert ml.score(fitted[name], known).count() == rows.count()


def test_settings_that_differ_in_iterations_are_one_fit(spark, rows, monkeypatch):
    configs = [{"maxIter": i, "maxDepth": 3, "stepSize": s} for i in (2, 6) for s in (0.05, 0.3)]
    fits, true = [], ml.GBTRegressor.fit
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, *args: (fits.append(self.getMaxIter()), true(self, *args))[1])
    got = {r.config: (r.max_iter, r.step_size, r.mae, r.wape) for r in ml.tune(rows, ["x", "y"], configs, ["c"]).collect()}
    assert fits == [6, 6]  # were four
    monkeypatch.undo()
    known = stored(ml.with_indicators(rows, ["x", "y"]), "known")
    for i, cfg in enumerate(configs):
        alone = ml.score(ml.fit(known.where("split = 'train'"), ["x", "y"], ml.GBTRegressor(seed=ml.SEED, **cfg), ["c"]), known.where("split = 'validation'"))
        (want,) = ml.metrics.accuracy(alone, ["source_dataset"], "label", "prediction").collect()
        assert got[i] == (cfg["maxIter"], cfg["stepSize"], want.mae, want.wape)


def test_folds_are_fitted_side_by_side(spark, rows, monkeypatch):
    meet, true = threading.Barrier(2, timeout=60), ml.fit  # one after the other would never meet
    monkeypatch.setattr(ml, "fit", lambda *args: (meet.wait(), true(*args))[1])
    days = lambda n: dt.date(2020, 1, 7) + dt.timedelta(days=7 * n)
    folds = spark.createDataFrame([("S", k, days(90 + 30 * k), days(91 + 30 * k), days(120 + 30 * k)) for k in range(2)], "source_dataset string, fold int, train_end date, val_start date, val_end date")
    made = ml.fold_models(rows, folds, ["x", "y"], 2, ml.boosted(2, 2), ["c"])
    assert {r.fold: r["count"] for r in made.groupBy("fold").count().collect()} == {0: 150, 1: 150}


def test_means_of_one_span_share_a_sort(spark):
    df = spark.createDataFrame([("a", i, None if i % 5 == 2 else float(i * i % 17)) for i in range(200)], "k string, t int, v double")
    made = add_past_ewm(df, ["k"], "t", "v", {"e4": 4, "e13": 13})
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # were four
    num, den, keep = 0.0, 0.0, 1 - 2 / 14
    for r in sorted(made.collect(), key=lambda r: r.t):
        assert r.e13 is None if not den else r.e13 == pytest.approx(num / den, rel=1e-9)
        num, den = num * keep + (r.v or 0.0), den * keep + (r.v is not None)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(8)
    made = []
    for k in range(4):
        for i in range(90 if k < 3 else 12):
            day = dt.date(2020, 1, 7) + dt.timedelta(days=7 * (i if k < 3 else i + 78))
            units = None if k == 1 and i % 6 == 4 else float(rng.choice([0, 0, 3, 8]) + (i % 4) * 4)
            split = "train" if day < dt.date(2021, 1, 1) else "validation" if day < dt.date(2021, 4, 1) else "test"
            made.append(("SYNTHETIC", f"S{k}", "p", day, units, (units or 0) * 2.5, split))
    return stored(spark.createDataFrame(made, "source_dataset string, entity_id string, product_key string, date date, units_sold double, revenue double, split string").coalesce(1), "panel")


def test_recursion_feeds_back_what_the_model_says(spark, panel):
    """Steps in plain Python, scored one at a time by MLlib's own model; nulls are no values, and few rows come in a batch."""
    import numpy as np
    from demandloom.operators import scenarios
    from pyspark.ml.linalg import Vectors

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    models, true = [], ml.fit
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ml, "fit", lambda rows, *args: (models.append((rows.count(), true(rows.where("label IS NOT NULL"), *args))), models[-1][1])[1])
            got = {(r.entity_id, r.origin_date, r.horizon): (r.target_date, r.actual, r.prediction) for r in ml.recursive(panel.where("split <> 'train' OR units_sold IS NOT NULL"), (1, 3, 7), trees=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    (learned, model), = models
    prepared, trees = model.stages[0], model.stages[-1]
    of = {}
    for r in sorted(panel.where("split <> 'train' OR units_sold IS NOT NULL").collect(), key=lambda r: r.date):
        of.setdefault(r.entity_id, []).append(r)
    assert learned == sum(1 for rows in of.values() for i, r in enumerate(rows) if r.split == "train" and i)
    want = {}
    for entity, rows in of.items():
        first = next(i for i, r in enumerate(rows) if r.split == "test")
        for i in range(first, len(rows), 7):
            past, future = rows[max(0, i - 35):i], rows[i:i + 30]
            values = [r.units_sold for r in past if r.units_sold is not None]
            prices = [r.revenue / r.units_sold for r in rows[:i] if r.units_sold]
            if not values or len(future) < 2:
                continue
            for h, r in enumerate(future[:7], 1):
                state = np.zeros((1, 35))
                state[0, 35 - len(values):] = values
                none = np.zeros(1)
                found = scenarios.terms(scenarios.State(state, np.array([len(values)]), np.array([r.date], "datetime64[D]"), none, none))
                given = [float(found[c][0]) for c in ml.OWN_TERMS] + [prices[-1] if prices else None]
                inputs = [m if v is None else v for v, m in zip(given, prepared.medians.values())] + [float(given[prepared.numeric.index(c)] is None) for c in prepared.gaps]
                p = max(0.0, trees.predict(Vectors.dense(inputs)))
                if h in (1, 3, 7):
                    want[entity, past[-1].date, h] = (r.date, r.units_sold, pytest.approx(p, rel=1e-9))
                values = [*values, p][-35:]
    assert got == want and len(want) > 20


def test_permutation_scores_a_row_once_and_equals_scoring_each_feature(spark, rows):
    known = stored(ml.with_indicators(rows, ["x", "y"]).withColumn("label", F.when(F.col("x") > 0.02, F.col("label"))), "known")
    model = ml.fit(known.where("split = 'train' AND label IS NOT NULL"), ["x", "y"], ml.boosted(5, 3), ["c"])
    held, keys = known.where("split <> 'train'"), ["product_key", "week"]
    made = ml.permutation_importance(model, held, keys, 2, bucket_rows=64)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "explode" not in plan  # a row stood once for each feature
    error = lambda df: df.select(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    base, want = error(ml.score(model, held)), {}
    for c in ("x", "y", "c"):
        parts = [ml.shuffled(held.withColumn("_moved", F.struct("x", "y", "c")), "_moved", keys, ml.SEED + k, held.count() // 64) for k in range(2)]
        want[c] = error(ml.score(model, parts[0].unionByName(parts[1]).withColumn(c, F.col(f"_moved.{c}")).drop("_moved"))) - base
    assert {r.feature: (r.mae_increase, r.repeats) for r in made.collect()} == {c: (pytest.approx(w, abs=2e-6), 2) for c, w in want.items()}


def test_hurdle_scores_rows_where_they_lie(spark, rows, monkeypatch):
    meet, true = threading.Barrier(2, timeout=60), ml.fit  # classifier and regressor wait for each other
    monkeypatch.setattr(ml, "fit", lambda *args: (meet.wait(), true(*args))[1])
    panel = rows.withColumns({"entity_id": F.lit("e"), "date": F.col("week"), "units_sold": F.when(F.col("x") > 0.4, F.col("units_sold")).otherwise(0.0)})
    table = ml.hurdle(panel.drop("week"), ["x", "y"], (0.3, 0.6), 3)
    assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()  # was joined by series and date
    got = {(r.split, r.threshold): r.n for r in table.collect()}
    assert got == {(s, h): 150 for s in ("validation", "test") for h in (0.3, 0.6)}
    assert table.where("selected").select("threshold").distinct().count() == 1


def test_forecasts_of_a_cut_panel_are_those_of_the_whole(spark, sf):
    """Weeks that no forecast looks back to are not filled in; what is forecast stays, null keys and dates too."""
    from demandloom.operators import baselines
    from demandloom.sources.retail import Retail
    from demandloom.functions.vocabulary import HORIZONS

    t = Retail(spark, sf)
    whole, cut = t.panel, t.panel_since("test_start", 36)
    assert cut.count() < whole.count() / 2  # all weeks were sorted
    assert cut.where("source_dataset = 'UCI'").count() == whole.where("source_dataset = 'UCI'").count()
    rounded = lambda df: df.withColumns({c: F.round(c, 9) for c in ("prediction", "lower_bound", "upper_bound")})
    want, got = rounded(baselines.horizon_forecasts(whole, HORIZONS)), rounded(t.forecast_rows)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert rounded(t.forecasts_at([1])).exceptAll(want.where("horizon = 1")).isEmpty()
    late = lambda p: baselines.attach_baselines(p).where("split <> 'train'").select("source_dataset", "entity_id", "product_key", "date", F.round("moving_average_7", 9))
    assert late(t.panel_since("val_start", 7)).exceptAll(late(whole)).isEmpty() and late(t.panel_since("val_start", 7)).count() == late(whole).count()
