"""Streams drained from files, and invariants of fitted models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandloom.operators import ml
from demandloom.sources import files
from demandloom.streaming import admission, requests


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    # one key holds most of the log
    rows = [(i, start + dt.timedelta(seconds=17 * i), 1 if rng.random() < 0.6 else rng.randint(2, 5), "click", 1.0, '{"k": 1}') for i in range(400)]
    folder = str(tmp_path_factory.mktemp("log"))
    df = spark.createDataFrame(rows, requests.EVENTS)
    for k in range(4):
        df.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def stream_of(spark, folder):
    return spark.readStream.schema(requests.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def admitted(rows, limit, seconds):
    held, want = {}, {}
    for event, ts, user, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = [x for x in held.get(user, []) if x >= ts - dt.timedelta(seconds=seconds)]
        want[event] = len(recent) < limit
        held[user] = recent + [ts] * want[event]
    return want


@pytest.mark.parametrize("limit, slot", [(5, None), (5, 1000), (0, None)])
def test_admission_of_a_hot_key_matches_plain_loop(spark, log, limit, slot):
    rows, folder = log
    got = {r.event_id: (r.user_id, r.admitted) for r in admission.drain(spark, folder, limit, 120, 1, "1 hour", slot, files="*.parquet").collect()}
    want = admitted(rows, limit, 120)
    assert got == {r[0]: (r[2], want[r[0]]) for r in rows} and not all(want.values())
    assert spark.conf.get(admission.STORE) != admission.ROCKSDB


def test_admission_orders_events_and_holds_a_slot_at_most(spark, tmp_path, monkeypatch):
    """Events come in no order, with equal times and without a user; a slot is what is ordered at once."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randint(0, 3000)), rng.choice([1, 1, None, 2]), "click", 1.0, None) for i in range(300)]
    rng.shuffle(rows)
    odd = [(None, start, 1, "click", 1.0, None), (1000, None, 1, "click", 1.0, None)]
    spark.createDataFrame(rows + odd, requests.EVENTS).coalesce(1).write.parquet(str(tmp_path / "log"))
    got = {r.event_id: r.admitted for r in admission.drain(spark, str(tmp_path / "log"), 3, 60, lateness="2 hours", slot_seconds=30, files="*.parquet").collect()}
    assert got == admitted(rows, 3, 60)


def test_trailing_breaches_match_brute_force(spark, log):
    rows, folder = log
    got = {r.event_id: r.in_window for r in requests.trailing_breaches(spark.read.parquet(folder), 5, 120).collect()}
    want = {}
    for event, ts, user, *_ in rows:
        n = sum(1 for _, x, u, *_ in rows if u == user and ts - dt.timedelta(seconds=120) <= x <= ts)
        if n > 5:
            want[event] = n
    assert got == want and want


def test_stream_metrics_equal_batch_for_closed_windows(spark, log):
    rows, folder = log
    out = requests.run_available(requests.windowed_metrics(stream_of(spark, folder), "10 minutes", "1 minute"), requests.stream_folder(spark, "t-metrics"))
    batch = {r.window_start: r.request_count for r in requests.windowed_metrics(spark.read.parquet(folder), "10 minutes").collect()}
    got = {r.window_start: r.request_count for r in out.collect()}
    limit = rows[-1][1] - dt.timedelta(minutes=1)
    assert got == {w: n for w, n in batch.items() if w + dt.timedelta(minutes=10) <= limit}


def test_updated_windows_equal_batch_with_late_files(spark, log, tmp_path):
    _, folder = log
    late = str(tmp_path / "late")
    for low in (300, 0, 200, 100):  # files out of time order
        spark.read.parquet(folder).where(F.col("event_id").between(low, low + 99)).coalesce(1).write.mode("append").parquet(late)
    out = requests.run_updates(requests.windowed_metrics(stream_of(spark, late), "10 minutes"), requests.stream_folder(spark, "t-updates"), ["window_start"])
    want = requests.windowed_metrics(spark.read.parquet(folder), "10 minutes")
    assert sorted(out.collect()) == sorted(want.collect()) and out.count() > 5


def test_redaction_at_any_depth(spark):
    value = '{"v": {"w": "s3cret"}}'
    texts = []
    for _ in range(6):
        texts += ['{"Token": %s, "k": 1}' % value, '{"list": [1, {"PASSWORD": [[%s]]}], "k": 1}' % value]
        value = '{"a": %s}' % value
    df = spark.createDataFrame([(x,) for x in texts], "props string")
    rows = [r[0] for r in df.select(requests.redact("props", F.lit('{"more": 2}'))).collect()]
    assert not any("s3cret" in x for x in rows) and all('"k":1' in x and '"more":2' in x and requests.HIDDEN in x for x in rows)


def test_redaction_and_truncation_of_odd_records(spark):
    texts = ['{"note": "%s", "k": [%s]}' % ("y" * 600, ",".join(map(str, range(30)))), None, "", "[1, {\"secret\": 5}]", "not json: s3cret", "[" * 100_000]
    rows = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, p string").orderBy("i").select(requests.redact("p", F.lit("{}"))).collect()]
    import json

    first = json.loads(rows[0])
    assert len(first["note"]) == 501 and first["note"].endswith("…") and first["k"] == list(range(20))
    assert rows[1:3] == ["{}", "{}"] and json.loads(rows[3]) == {"value": [1, {"secret": requests.HIDDEN}]}
    assert rows[4] == rows[5] == '{"unreadable": "[REDACTED]"}'


def test_manifest_difference_and_fallback(spark, tmp_path):
    df = spark.range(100).withColumn("p", F.col("id") % 3)
    a = files.fingerprint(df, ["p"])
    from demandloom.operators import monitoring
    b = files.fingerprint(df.where("p < 2").withColumn("id", F.when(F.col("id") == 3, 4).otherwise(F.col("id"))), ["p"])
    state = {r.path: r.state for r in monitoring.compare_manifests(a, b).collect()}
    assert state == {"p=0": "CHANGED", "p=1": "SAME", "p=2": "REMOVED"}
    df.write.option("header", True).csv(str(tmp_path / "x.csv"))
    assert files.resolve(spark, ("parquet", str(tmp_path / "x.parquet")), ("csv", str(tmp_path / "x.csv"))).count() == 100


def test_shuffle_is_a_permutation_and_repeatable(spark):
    df = spark.range(2000).withColumn("v", F.col("id") * 10)
    moved = ml.shuffled(df, "v", ["id"], 1, buckets=16)
    rows = {r.id: r.v for r in moved.collect()}
    assert sorted(rows.values()) == [i * 10 for i in range(2000)]
    assert sum(v == k * 10 for k, v in rows.items()) < 50
    assert rows == {r.id: r.v for r in ml.shuffled(df.repartition(7), "v", ["id"], 1, buckets=16).collect()}


@pytest.fixture(scope="module")
def weekly(spark):
    rng = random.Random(4)
    base = dt.date(2020, 1, 7)
    rows = [("SYNTHETIC", f"p{k}", base + dt.timedelta(days=7 * i), 10 + k + (i % 4) * 5 + rng.randint(0, 2), 2.0, 0) for k in range(6) for i in range(70)]
    return spark.createDataFrame(rows, "source_dataset string, product_key string, week date, units_sold long, avg_unit_price double, promotion_flag int")


def test_model_comparison_and_intervals(spark, weekly):
    from demandloom.operators import features
    rows = ml.chronological(features.weekly_features(weekly))
    table, fitted = ml.train_and_compare(rows, list(ml.WEEKLY_NUMERIC), {"linear": ml.candidates()["linear"], "gradient_boosting": ml.boosted(3)})
    got = table.collect()
    assert len(got) == 4 and {r.split for r in got} == {"validation", "test"} and all(r.mae >= 0 for r in got)
    scored = ml.score(fitted["linear"], ml.with_indicators(rows, list(ml.WEEKLY_NUMERIC)))
    assert scored.where("prediction < 0").count() == 0
    bounds = ml.conformal_intervals(scored.select("source_dataset", "split", F.col("label").alias("actual"), "prediction"))
    assert bounds.where("lower_bound > p50 OR p50 > upper_bound OR lower_bound < 0").count() == 0 and bounds.count() > 0


def test_prepared_features_know_the_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None, "a"), (3.0, 5.0, "a"), (8.0, 7.0, "b"), (None, 9.0, None)], "x double, y double, c string").withColumn("z", F.lit(None).cast("double"))
    model = ml.FeaturePreparer(["x", "y", "z"], ["c"]).fit(train)
    assert model.names == ["x", "y", "z", "x_missing", "y_missing", "z_missing", "c_freq"]
    new = spark.createDataFrame([(None, 2.0, "a"), (4.0, None, "never seen"), (4.0, None, None)], "x double, y double, c string").withColumn("z", F.lit(1.5))
    rows = sorted((r.c or "", list(map(float, r.features.toArray()))) for r in model.transform(new).collect())
    assert rows == [("", [4.0, 7.0, 1.5, 0.0, 1.0, 0.0, 0.0]), ("a", [3.0, 2.0, 1.5, 1.0, 0.0, 0.0, 0.5]), ("never seen", [4.0, 7.0, 1.5, 0.0, 1.0, 0.0, 0.0])]


def test_permutation_importance_tells_the_feature_that_counts(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.random()), float(rng.random()), rng.choice("ab")) for i in range(600)]
    df = spark.createDataFrame([(*r, 10 * r[1] + (5 if r[3] == "a" else 0)) for r in rows], "id int, x double, noise double, c string, units_sold double")
    df = ml.with_indicators(df, ["x", "noise"])
    model = ml.fit(df.where("id % 3 > 0"), ["x", "noise"], ml.boosted(10, 3), ["c"])
    found = {r.feature: r for r in ml.permutation_importance(model, df.where("id % 3 = 0"), ["id"]).collect()}
    assert set(found) == {"x", "noise", "c"} and found["x"].mae_increase > 1.0 > abs(found["noise"].mae_increase) and found["x"].repeats == 3
    native = {r.feature: r.importance for r in ml.native_importance(model, df).collect()}
    assert native["x"] > native["noise"] and set(native) == {"x", "noise", "c_freq"}


def test_intervals_fall_back_to_the_group(spark):
    rng = random.Random(6)
    rows = [("s", split, regime, 10.0 + rng.random() * width, 10.0) for split in ("validation", "test") for regime, width, n in (("low", 1.0, 80), ("high", 9.0, 80), ("rare", 50.0, 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "source_dataset string, split string, regime string, actual double, prediction double")
    made = ml.conformal_intervals(df, within=["regime"]).groupBy("regime").agg(F.max("upper_bound").alias("hi"), F.min("upper_bound").alias("lo"), F.count("*").alias("n")).collect()
    bound = {r.regime: r.hi for r in made}
    whole = ml.conformal_intervals(df).agg(F.max("upper_bound").alias("hi")).first().hi
    assert bound["low"] < 11.1 < bound["high"] and bound["rare"] == whole and sum(r.n for r in made) == len(rows) and all(r.hi == r.lo for r in made)


def test_recursive_forecasts_keep_the_steps_an_origin_has(spark, weekly):
    panel = weekly.withColumnRenamed("week", "date").withColumns({"entity_id": F.lit("S"), "revenue": F.col("units_sold") * 2.0, "units_sold": F.col("units_sold").cast("double")})
    n = F.date_diff("date", F.lit("2020-01-07")) / 7
    panel = panel.withColumn("split", F.when(n < 50, "train").when(n < 60, "validation").otherwise("test"))
    short = panel.where("product_key = 'p0'").withColumn("product_key", F.lit("short")).where(n >= 65)
    made = ml.recursive(panel.unionByName(short), trees=3).toPandas()
    counts = made[made.product_key == "p1"].groupby("horizon").size().to_dict()
    assert counts == {1: 2, 3: 2, 7: 1} and (made.prediction >= 0).all()
    assert made[made.product_key == "short"].groupby("horizon").size().to_dict() == {} or made[made.product_key == "short"].origin_date.min() >= dt.date(2021, 4, 6)
    days = made[(made.product_key == "p1") & (made.horizon == 7)].iloc[0]
    assert (days.target_date - days.origin_date).days == 49 and days.actual in set(r.units_sold for r in panel.where("product_key = 'p1'").collect())
    error = (made.actual - made.prediction).abs().mean()
    assert error < 5  # the series repeat every four weeks


def test_independent_fits_run_side_by_side(spark):
    import threading
    from demandloom.session import side_by_side

    meet = threading.Barrier(2, timeout=60)  # one after the other would never meet
    assert side_by_side(spark, [lambda: meet.wait() >= 0 and spark.range(3).count(), lambda: meet.wait() >= 0 and spark.range(5).count()]) == [3, 5]


def test_levels_of_all_categories_are_counted_at_once(spark):
    import os
    from demandloom.session import shared_dir

    kept = lambda: len([x for x in os.listdir(f"{shared_dir(spark)}/stages") if x.startswith("levels-")])
    train = spark.createDataFrame([(1.0, "a", "x"), (2.0, "a", "y"), (3.0, None, "y"), (4.0, "b", "y")], "v double, c string, d string")
    os.makedirs(f"{shared_dir(spark)}/stages", exist_ok=True)
    before = kept()
    model = ml.FeaturePreparer(["v"], ["c", "d"]).fit(train)
    assert kept() == before + 1
    assert sorted(tuple(r.features.toArray()) for r in model.transform(train).collect()) == [(1.0, 0.5, 0.25), (2.0, 0.5, 0.75), (3.0, 0.0, 0.75), (4.0, 0.25, 0.75)]
