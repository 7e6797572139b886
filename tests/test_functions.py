"""Numeric and calendar conventions on small frames."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.functions import quantiles, recurrences, scan, semantics


def one(df):
    return df.collect()[0]


def test_rounding_is_half_to_even_and_never_negative_zero(spark):
    values = [0.5, 1.5, 2.5, -0.00001, 0.00005, 0.00015]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(semantics.rnd("x", 0)).collect()]
    assert got[:3] == [0.0, 2.0, 2.0] and str(got[3]) == "0.0"
    assert [r[0] for r in df.select(semantics.rnd("x", 4)).collect()] == [float(np.round(v, 4)) + 0.0 for v in values]


def test_ratio_and_sum_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, c double")
    row = one(df.agg(semantics.zero_sum("c"), F.max(semantics.ratio("a", "b"))))
    assert row[0] == 0 and row[1] is None


def test_weeks_end_on_monday(spark):
    days = pd.date_range("1999-12-20", "2000-02-10")
    df = spark.createDataFrame([(d.date(),) for d in days], "d date")
    got = {r.d: r.w for r in df.select("d", semantics.week_start("d").alias("w")).collect()}
    assert got == {d.date(): d.to_period("W-MON").start_time.date() for d in days}


def test_most_common_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("j", "z")], "k string, v string")
    assert {r.k: r.v for r in semantics.most_common(df, "k", "v").collect()} == {"k": "a", "j": "z"}


@pytest.mark.parametrize("size", [1, 2, 7, 5000])
def test_exact_quantiles_match_numpy_with_a_hot_group(spark, size):
    rng = random.Random(size)
    rows = [("hot", float(rng.choice([0, 0, 0, rng.random() * 100]))) for _ in range(size)]
    rows += [("small", float(i)) for i in range(3)] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: r for r in quantiles.exact_quantiles(df, "x", probs, ["g"], names).collect()}
    for g in ("hot", "small"):
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g].n == len(values)
        assert [got[g][n] for n in names] == pytest.approx(np.quantile(values, probs))


def test_quantile_table_of_two_columns(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(11)], "g string, x double, y double")
    row = one(quantiles.quantile_table(df, ["x", "y"], [0.5, 0.9], ["g"]))
    assert (row.x_q0, row.x_q1, row.y_q0, row.y_q1) == (5.0, 9.0, 25.0, 81.0)


def test_past_ewm_matches_pandas(spark):
    rng = random.Random(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(k, d, float(rng.randint(0, 20))) for k in "ab" for d in days]
    df = spark.createDataFrame(rows, "k string, date date, y double")
    got = recurrences.add_past_ewm(df, ["k"], "date", "y", {"e4": 4, "e13": 13}).toPandas().sort_values(["k", "date"])
    for k, g in got.groupby("k"):
        for span in (4, 13):
            want = g["y"].shift(1).ewm(span=span, min_periods=1).mean()
            np.testing.assert_allclose(g[f"e{span}"].astype(float), want, rtol=1e-12)


def plain_croston(ys, alpha, beta):
    level, gap, prob, idle, out = 0.0, 1.0, 0.0, 0, []
    for y in ys:
        out.append((level, gap, prob))
        if y > 0:
            if level == 0.0 and gap == 1.0 and idle == 0:
                level, gap = y, float(idle + 1)
            else:
                level, gap = level + alpha * (y - level), gap + alpha * (idle + 1 - gap)
            gap, prob, idle = max(gap, 1.0), prob + beta * (1 - prob), 0
        else:
            idle, prob = idle + 1, prob - beta * prob
    return out


@pytest.mark.parametrize("ys", [[0, 0, 3, 0, 5, 0, 0, 1], [4, 0, 0, 2, 2, 0, 7], [0, 0, 0], [1]])
def test_intermittent_matches_plain_loop(spark, ys):
    df = spark.createDataFrame([(k, i, float(y)) for k in "ab" for i, y in enumerate(ys if k == "a" else [7, *ys])], "k string, i int, y double")
    path = recurrences.add_intermittent(df, ["k"], "i", "y", 0.1, 0.1).orderBy("k", "i").collect()
    np.testing.assert_allclose([(p.level, p.gap, p.prob) for p in path], plain_croston(ys, 0.1, 0.1) + plain_croston([7, *ys], 0.1, 0.1), atol=1e-15)


def test_long_series_are_linear_and_equal_to_the_loop(spark):
    rng = random.Random(8)
    ys = [float(rng.choice([0, 0, 0, rng.randint(1, 30)])) for _ in range(100_000)]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(len(ys)), "y": ys}))
    got = recurrences.add_intermittent(df, ["k"], "i", "y", 0.1, 0.1).orderBy("i").toPandas()
    np.testing.assert_allclose(got[["level", "gap", "prob"]].to_numpy(), plain_croston(ys, 0.1, 0.1), rtol=1e-9, atol=1e-12)
    got = recurrences.add_past_ewm(df, ["k"], "i", "y", {"short": 2, "long": 90}).orderBy("i").toPandas()
    for name, span in (("short", 2), ("long", 90)):
        np.testing.assert_allclose(got[name].astype(float), pd.Series(ys).shift(1).ewm(span=span, min_periods=1).mean(), rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        recurrences.block_length(1.0)


@pytest.mark.parametrize("rows", [1, 40, 50_000])
def test_running_totals_with_a_hot_group_and_a_tied_value(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "RANGE_ROWS", 16)
    rng = random.Random(rows)
    data = [(rng.choice(["hot", "hot", None, "b"]), rng.choice([5, 5, 5, rng.randint(0, 9)]), i) for i in range(min(rows, 600))]
    df = spark.createDataFrame(data, "g string, v int, k int").withColumn("one", F.lit(1).cast("long"))
    got = scan.running_totals(df.cache(), ["g"], [F.desc("v"), F.col("k")], {"rank": "one", "run": "v"}).collect()
    for g in ("hot", None, "b"):
        want = sorted(((-v, k) for x, v, k in data if x == g))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [(-r.v, r.k) for r in mine] == want and [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert [r.run for r in mine] == [-sum(v for v, _ in want[: i + 1]) for i in range(len(want))]
        assert all(r.rank_all == len(want) for r in mine)
