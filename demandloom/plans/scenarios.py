"""Scenario forecast queries, with the model fitted and the path walked in SQL."""

import math

from pyspark.sql import functions as F

from demandloom.functions.semantics import rnd
from demandloom.operators import scenarios
from demandloom.plans.registry import query
from demandloom.plans.sqltext import r

KEYS = ["store_id", "sku_id"]
HORIZON, DISCOUNT, PROMO, SURGE = 14, 0.15, 1, 1.2

SALES = """SELECT CAST(l_shipdate AS DATE) AS date, concat('STORE_', CAST(l_suppkey AS VARCHAR)) AS store_id, replace(p_brand, 'Brand#', 'SKU_') AS sku_id, CAST(SUM(l_quantity) AS DOUBLE) AS y,
 1 - SUM(l_extendedprice * (1 - l_discount)) / NULLIF(SUM(l_extendedprice), 0) AS discount, MAX(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS promo
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def last(rows: int) -> str:
    return f"v[greatest(len(v) - {rows - 1}, 1):len(v)]"


def ewm(span: int, rows: int) -> str:
    keep, n = num(1.0 - 2.0 / (span + 1.0)), f"least(len(v), {rows})"
    return f"list_sum(list_transform(range(0, {n}), lambda j: pow({keep}, j) * v[len(v) - j])) / list_sum(list_transform(range(0, {n}), lambda j: pow({keep}, j)))"


def terms() -> dict[str, str]:
    """The operator's terms over a list v of earlier values, a day d, a discount and a promotion."""
    weekday, month = "(isodow(d) - 1)", "month(d)"
    return {
        "month": month, "quarter": "quarter(d)", "day_of_month": "day(d)", "day_of_week": weekday, "is_weekend": f"CASE WHEN {weekday} >= 5 THEN 1 ELSE 0 END",
        "sin_day_of_week": f"sin({weekday} * {num(2 * math.pi / 7)})", "cos_day_of_week": f"cos({weekday} * {num(2 * math.pi / 7)})",
        "sin_month": f"sin({month} * {num(2 * math.pi / 12)})", "cos_month": f"cos({month} * {num(2 * math.pi / 12)})", "discount_pct": "discount", "promotion_flag": "promo",
        **{f"lag_{k}": f"CASE WHEN len(v) >= {k} THEN v[len(v) - {k - 1}] ELSE v[len(v)] END" for k in scenarios.LAGS},
        "rolling_mean_7": f"list_avg({last(7)})", "rolling_std_7": f"list_stddev_pop({last(7)})", "rolling_mean_14": f"list_avg({last(14)})", "rolling_mean_30": f"list_avg({last(30)})",
        "ewm_7": ewm(7, 14), "ewm_28": ewm(28, scenarios.MEMORY),
    }


def model() -> str:
    """CTEs up to ``fitted`` (one row: w, intercept): ridge on the standardised terms by elimination without pivots."""
    found = terms()
    n = len(found)
    x = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(found.values(), 1))
    every = [f"x{i}" for i in range(1, n + 1)] + ["y"]
    pairs = {(i, j): f"c{i}_{j}" for i in range(n + 1) for j in range(i, n + 1)}
    moments = ", ".join([f"covar_pop({every[i]}, {every[j]}) AS {name}" for (i, j), name in pairs.items()] + [f"avg({e}) AS m{i}" for i, e in enumerate(every)])
    # deviations; a term that never changes counts for nothing
    sd = [f"sqrt({pairs[i, i]})" for i in range(n + 1)]
    ridge = f"{num(scenarios.RIDGE)} / {sd[n]}"

    def cell(i: int, j: int) -> str:
        if i == j:
            return f"CASE WHEN {sd[i]} > 0 THEN 1 ELSE 0 END + {ridge}"
        return f"COALESCE({pairs[min(i, j), max(i, j)]} / NULLIF({sd[i]} * {sd[j]}, 0), 0)"

    matrix = "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(n + 1)) + "]" for i in range(n)) + "]"
    deviations = "[" + ", ".join(sd) + "]"
    means = "[" + ", ".join(f"m{i}" for i in range(n + 1)) + "]"
    return f"""sales AS ({SALES}),
training AS (SELECT {x}, y FROM (SELECT y, date AS d, COALESCE(discount, 0) AS discount, promo, list(y) OVER (PARTITION BY store_id, sku_id ORDER BY date ROWS BETWEEN {scenarios.MEMORY} PRECEDING AND 1 PRECEDING) AS v FROM sales) WHERE len(v) > 0),
moments AS (SELECT {moments} FROM training),
stated AS (SELECT {matrix} AS m, {deviations} AS sd, {means} AS mean FROM moments),
solved(k, m, sd, mean) AS (
  SELECT 0, m, sd, mean FROM stated
  UNION ALL
  SELECT k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[i], lambda c: c / m[k + 1][k + 1])
    ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END), sd, mean FROM solved WHERE k < {n}),
weighed AS (SELECT list_transform(range(1, {n + 1}), lambda i: CASE WHEN sd[i] > 0 THEN m[i][{n + 1}] * sd[{n + 1}] / sd[i] ELSE 0 END) AS w, mean FROM solved WHERE k = {n}),
fitted AS (SELECT w, mean[{n + 1}] - list_dot_product(w, mean[1:{n}]) AS intercept FROM weighed)"""


def path(horizon: int, discount: float | None, promo: int | None, surge: float, value: str | None = None) -> str:
    """CTEs up to ``walked`` (store_id, sku_id, last, step, value, spread, discount, promo)."""
    found = ", ".join(f"CAST({e} AS DOUBLE)" for e in terms().values())
    value = value or f"greatest(0, intercept + list_dot_product(w, [{found}]))"
    of = lambda given, name: f"COALESCE(arg_max({name}, date), 0)" if given is None else repr(given)
    return f"""begun AS (SELECT store_id, sku_id, max(date) AS last, list(y ORDER BY date) AS every, CAST({of(discount, 'discount')} AS DOUBLE) AS discount, CAST({of(promo, 'promo')} AS INTEGER) AS promo FROM sales GROUP BY 1, 2),
walked(store_id, sku_id, last, step, v, value, spread, discount, promo) AS (
  SELECT store_id, sku_id, last, 0, every[greatest(len(every) - {scenarios.MEMORY - 1}, 1):len(every)], CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), discount, promo FROM begun
  UNION ALL
  SELECT store_id, sku_id, last, step + 1, list_append({last(scenarios.MEMORY - 1)}, value), value, spread, discount, promo FROM (
    SELECT store_id, sku_id, last, step, v, discount, promo, {value} * {num(surge)} AS value, greatest(1, list_stddev_pop({last(7)}) * sqrt(1 + step / CAST(10 AS DOUBLE))) AS spread
    FROM (SELECT *, CAST(last + (step + 1) AS DATE) AS d FROM walked), fitted WHERE step < {horizon}))"""


ROWS = f"""SELECT store_id, sku_id, CAST(last + step AS DATE) AS date, CAST(step AS INTEGER) AS step, {r('value', 2)} AS forecast_units, {r('greatest(0, value - CAST(1.96 AS DOUBLE) * spread)', 2)} AS forecast_lower,
 {r('value + CAST(1.96 AS DOUBLE) * spread', 2)} AS forecast_upper, discount AS discount_applied, promo AS promo_applied FROM walked WHERE step > 0"""


@query("b10_scenario_forecast", f"WITH RECURSIVE {model()}, {path(HORIZON, DISCOUNT, PROMO, SURGE)} {ROWS}")
def b10(t):
    """Path of every store x SKU series under 15 % discount, promotion and 20 % surge."""
    return scenarios.scenario(t.daily_units, HORIZON, KEYS, scenarios.fit_path(t.daily_units, KEYS), discount=DISCOUNT, promo=PROMO, surge=SURGE)


@query("b10_scenario_as_is", f"""WITH RECURSIVE {model()}, {path(HORIZON, None, None, 1.0)} SELECT step, count(*) AS series, {r('sum(value)', 2)} AS forecast_units, {r('sum(spread)', 2)} AS spread, {r('avg(discount)', 6)} AS discount_applied
 FROM (SELECT CAST(step AS INTEGER) AS step, {r('value', 2)} AS value, {r('value + CAST(1.96 AS DOUBLE) * spread', 2)} AS spread, discount FROM walked WHERE step > 0) x GROUP BY 1""")
def b10_as_is(t):
    """The same with the last discount and promotion of each series, added up by step."""
    rows = scenarios.scenario(t.daily_units, HORIZON, KEYS, scenarios.fit_path(t.daily_units, KEYS))
    return rows.groupBy("step").agg(F.count("*").alias("series"), rnd(F.sum("forecast_units"), 2).alias("forecast_units"), rnd(F.sum("forecast_upper"), 2).alias("spread"), rnd(F.avg("discount_applied"), 6).alias("discount_applied"))


# a memory of one value and no surge give a constant path, which plain SQL can say
@query("b10_flat_scenario", f"""
WITH p AS (SELECT store_id, sku_id, max(date) AS d, list(CAST(units_sold AS DOUBLE) ORDER BY date) AS v, count(*) AS n, arg_max(promotion_flag, date) AS promo FROM sales_daily GROUP BY 1, 2),
 q AS (SELECT *, v[n] AS last, v[greatest(n - 6, 1):n] AS w FROM p)
SELECT store_id, sku_id, d + 1 AS date, 1 AS step, {r('last', 2)} AS forecast_units, {r('greatest(0, last - CAST(1.96 AS DOUBLE) * greatest(1, list_stddev_pop(w)))', 2)} AS forecast_lower,
 {r('last + CAST(1.96 AS DOUBLE) * greatest(1, list_stddev_pop(w))', 2)} AS forecast_upper, CAST(0 AS DOUBLE) AS discount_applied, promo AS promo_applied FROM q""")
def b10_flat(t):
    return scenarios.scenario(t.daily_units, 1, KEYS, scenarios.mean_of_last(1), discount=0.0)
