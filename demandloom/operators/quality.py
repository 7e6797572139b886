"""Data-quality checks as one-pass aggregates and anti joins.

Each check returns a small DataFrame of counters; nothing is collected. Checks
over several columns share one scan and are turned into rows with ``stack``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.quantiles import exact_quantiles
from demandloom.functions.semantics import pct, ratio, rnd, series, to_long
from demandloom.functions.vocabulary import SEGMENTS
from demandloom.session import stored

N = "*"


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _stack(row: DataFrame, entries: Mapping[str, Sequence[str]], fields: Sequence[str], name: str, carry: Sequence[str] = ()) -> DataFrame:
    """One wide row to one row per entry; ``entries`` maps a name to its columns."""
    items = [F.struct(F.lit(key).alias(name), *[F.col(c).alias(f) for c, f in zip(cols, fields)]) for key, cols in entries.items()]
    return row.select(*carry, F.inline(F.array(*items)))


def contract(df: DataFrame, required: Sequence[str], keys: Sequence[str], dataset: str) -> DataFrame:
    """Missing and extra columns from the schema; emptiness and NULL keys from one scan."""
    missing = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in required]
    present = [k for k in keys if k in df.columns]
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in present], F.lit(False))
    return df.agg(F.count(N).alias("row_count"), F.count_if(any_null).alias("null_key_rows")).select(
        F.lit(dataset).alias("dataset"), F.lit(", ".join(missing)).alias("missing_columns"), F.lit(", ".join(extra)).alias("extra_columns"),
        F.lit(not missing).alias("schema_ok"), "row_count", (F.col("row_count") == 0).alias("is_empty"), "null_key_rows",
    )


def duplicates(df: DataFrame, keys: Sequence[str], dataset: str) -> DataFrame:
    """Rows beyond the first of each key (all columns for exact copies)."""
    groups = df.groupBy(*keys).agg(F.count(N).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("original_rows"), F.count(N).alias("final_rows")).select(
        F.lit(dataset).alias("dataset"), "original_rows", "final_rows", (F.col("original_rows") - F.col("final_rows")).alias("duplicate_rows"),
        F.coalesce(pct(F.col("original_rows") - F.col("final_rows"), "original_rows"), F.lit(0.0)).alias("duplicate_pct"),
    )


def date_profile(df: DataFrame, column: str, dataset: str, reference: str) -> DataFrame:
    parsed = F.try_to_timestamp(F.col(column).cast("string")).cast("date")
    missing = F.col(column).isNull()
    return df.agg(
        F.count_if(missing).alias("missing_dates"), F.count_if(parsed.isNull() & ~missing).alias("invalid_dates"),
        F.count_if(parsed > F.lit(reference).cast("date")).alias("future_dates"), F.min(parsed).alias("min_date"), F.max(parsed).alias("max_date"),
    ).withColumns({"dataset": F.lit(dataset), "total_days": F.date_diff("max_date", "min_date")})


def numeric_profile(df: DataFrame, columns: Sequence[str], dataset: str) -> DataFrame:
    fields = ["non_null", "negative", "zero", "positive", "min", "max", "mean"]
    aggs, entries = [], {}
    for c in columns:
        v = F.col(c).try_cast("double")
        made = [F.count(v), F.count_if(v < 0), F.count_if(v == 0), F.count_if(v > 0), F.min(v), F.max(v), rnd(F.avg(v), 6)]
        entries[c] = [f"{c}__{f}" for f in fields]
        aggs += [m.alias(n) for m, n in zip(made, entries[c])]
    return _stack(df.agg(*aggs), entries, fields, "column").withColumn("dataset", F.lit(dataset))


def missing_values(df: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    row = df.agg(F.count(N).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m__{c}") for c in columns])
    long = _stack(row, {c: [f"m__{c}"] for c in columns}, ["missing_count"], "column", ["_n"])
    return long.where(F.col("missing_count") > 0).select(
        F.lit(dataset).alias("dataset"), "column", "missing_count", pct("missing_count", "_n").alias("missing_pct")
    )


def outliers(df: DataFrame, columns: Sequence[str], dataset: str, z: float = 3.0) -> DataFrame:
    """IQR fences and z-scores per column; nothing is removed."""
    long = to_long(df.select(*[F.col(c).try_cast("double").alias(c) for c in columns]), [], columns, "column", "value").where(F.col("value").isNotNull())
    fences = exact_quantiles(long, "value", [0.25, 0.75], ["column"], ["q1", "q3"])
    moments = long.groupBy("column").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    spread = F.col("q3") - F.col("q1")
    bounds = fences.join(moments, "column").withColumns({"lower_bound": F.col("q1") - 1.5 * spread, "upper_bound": F.col("q3") + 1.5 * spread})
    rows = long.join(F.broadcast(bounds), "column")
    v = F.col("value")
    out_iqr = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    out_z = F.coalesce(F.abs(ratio(v - F.col("_mean"), "_std")) > z, F.lit(False))
    keep = ["n", "q1", "q3", "lower_bound", "upper_bound"]
    return rows.groupBy("column").agg(
        *[F.max(c).alias(c) for c in keep], F.count_if(out_iqr).alias("iqr_outlier_count"),
        F.min(F.when(out_iqr, v)).alias("iqr_outlier_min"), F.max(F.when(out_iqr, v)).alias("iqr_outlier_max"),
        F.count_if(out_z).alias("z_outlier_count"), F.min(F.when(out_z, v)).alias("z_outlier_min"), F.max(F.when(out_z, v)).alias("z_outlier_max"),
    ).withColumns({
        "dataset": F.lit(dataset), "iqr_outlier_pct": pct("iqr_outlier_count", "n"), "z_outlier_pct": pct("z_outlier_count", "n"),
    })


def referential(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, child_name: str, parent_name: str, listed: int = 50) -> DataFrame:
    """Orphan rows and the first ``listed`` orphan values in order.

    Child values are counted first, so the anti join moves distinct values; the
    value list is a top-k, never a collected set of all orphans.
    """
    values = child.groupBy(F.col(child_col).cast("string").alias("v")).agg(F.count(N).alias("n"))
    parents = parent.select(F.col(parent_col).cast("string").alias("v"), F.lit(True).alias("_hit")).distinct()
    marked = values.join(parents, "v", "left")
    totals = marked.agg(
        F.sum("n").alias("total_child_rows"), F.coalesce(F.sum(F.when(F.col("_hit"), F.col("n"))), F.lit(0)).alias("valid_relationships"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("orphan_records"),
    )
    first = marked.where(F.col("_hit").isNull() & F.col("v").isNotNull()).orderBy("v").limit(listed)
    sample = first.agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("s")).select("s").scalar()
    return totals.select(
        F.lit(child_name).alias("child_dataset"), F.lit(parent_name).alias("parent_dataset"), "total_child_rows", "valid_relationships",
        "orphan_records", sample.alias("orphan_values"),
    )


def grain(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    groups = df.groupBy(*keys).agg(F.count(N).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.when(any_null, F.col("_n"))), F.lit(0)).alias("null_key_count"),
    ).select(F.lit(table).alias("table_name"), F.lit("+".join(keys)).alias("grain"), "row_count", "duplicate_key_count", "null_key_count")


def orphans(fact: DataFrame, dim: DataFrame, keys: Sequence[str], fact_name: str, dim_name: str) -> DataFrame:
    """Fact rows without a dimension row; keys are counted before the join."""
    counted = fact.groupBy(*keys).agg(F.count(N).alias("_n"))
    missing = counted.join(dim.select(*keys).distinct(), list(keys), "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_count")).select(
        F.lit(fact_name).alias("fact"), F.lit(dim_name).alias("dim"), F.lit("+".join(keys)).alias("keys"), "orphan_count"
    )


# Keys and relations of the star schema.
GRAINS = {
    "dim_calendar": ("date",), "dim_product": ("product_key",), "dim_entity": ("source_dataset", "entity_id"), "dim_customer": ("customer_key",),
    "fact_sales": ("date", "source_dataset", "entity_id", "product_key"), "fact_inventory": ("date", "source_dataset", "entity_id", "product_key"),
    "fact_returns": ("date", "source_dataset", "entity_id", "product_key"), "fact_cancellations": ("date", "source_dataset", "entity_id", "product_key"),
    "inventory_analytics": ("date", "source_dataset", "entity_id", "product_key"), "customer_analytics": ("customer_key",),
    "forecast_base": ("date", "source_dataset", "entity_id", "product_key"),
}
DATE, PRODUCT, ENTITY = ("date",), ("product_key",), ("source_dataset", "entity_id")
RELATIONS = [
    ("fact_sales", "dim_calendar", DATE), ("fact_sales", "dim_product", PRODUCT), ("fact_sales", "dim_entity", ENTITY),
    ("fact_inventory", "dim_calendar", DATE), ("fact_inventory", "dim_product", PRODUCT), ("fact_inventory", "dim_entity", ENTITY),
    ("fact_returns", "dim_calendar", DATE), ("fact_returns", "dim_product", PRODUCT), ("fact_cancellations", "dim_calendar", DATE),
    ("fact_cancellations", "dim_product", PRODUCT), ("forecast_base", "dim_calendar", DATE), ("forecast_base", "dim_product", PRODUCT),
    ("forecast_base", "dim_entity", ENTITY),
]


def star_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union([orphans(tables[f], tables[d], k, f, d) for f, d, k in RELATIONS])


def integration_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    grains = union([
        grain(tables[t], k, t).withColumn("column_count", F.lit(len(tables[t].columns))) for t, k in GRAINS.items()
    ])
    broken = star_orphans(tables).groupBy(F.col("fact").alias("table_name")).agg(F.sum("orphan_count").alias("foreign_key_violations"))
    report = grains.join(broken, "table_name", "left").withColumn("foreign_key_violations", F.coalesce("foreign_key_violations", F.lit(0)))
    bad = F.col("duplicate_key_count") + F.col("null_key_count") + F.col("foreign_key_violations")
    return report.withColumn("status", F.when(bad > 0, "REVIEW").otherwise("PASS"))


def _verdict(row: DataFrame, checks: Sequence[str]) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in checks])
    return row.withColumns({"invalid_values": total, "quality_status": F.when(total > 0, "REVIEW").otherwise("PASS")})


def _master(df: DataFrame, key: str, rules: Mapping[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    row = df.agg(
        F.count(N).alias("original_rows"), F.count_if(F.col(key).isNull()).alias("missing_ids"),
        *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()], *extra,
    )
    dups = duplicates(df.select(key), [key], key).select("duplicate_rows").scalar()
    row = row.withColumn("duplicate_ids", dups)
    return _verdict(row, ["duplicate_ids", "missing_ids", *rules])


def store_rules(stores: DataFrame, reference: str = "2025-12-31") -> DataFrame:
    opened = F.col("opening_date")
    return _master(stores, "store_id", {
        "invalid_store_sizes": F.coalesce(F.col("store_size_sqft") <= 0, F.lit(False)),
        "invalid_opening_dates": F.coalesce(opened > F.lit(reference).cast("date"), F.lit(False)),
    })


def sku_rules(skus: DataFrame) -> DataFrame:
    no = lambda c: F.coalesce(c, F.lit(False))
    return _master(skus, "sku_id", {
        "invalid_cost_price": no(F.col("cost_price") <= 0), "invalid_base_price": no(F.col("base_price") <= 0),
        "invalid_weight_kg": no(F.col("weight_kg") <= 0), "invalid_lead_time_days": no(F.col("lead_time_days") <= 0),
        "negative_reorder_point": no(F.col("reorder_point") < 0), "negative_safety_stock": no(F.col("safety_stock") < 0),
        "missing_category": F.col("category").isNull(), "missing_supplier": F.col("supplier_id").isNull(),
        "cost_price_ge_base_price": no(F.col("cost_price") >= F.col("base_price")),
    })


def customer_rules(customers: DataFrame, reference: str = "2025-12-31") -> DataFrame:
    # a NULL is no member of the enumeration, so it counts as invalid
    return _master(customers, "customer_id", {
        "invalid_loyalty_member": ~F.col("loyalty_member").isin(0, 1), "invalid_segment": ~F.col("customer_segment").isin(*SEGMENTS),
        "invalid_signup_dates": F.coalesce(F.col("signup_date") > F.lit(reference).cast("date"), F.lit(False)),
    })


def calendar_rules(calendar: DataFrame) -> DataFrame:
    d = F.col("date")
    off = lambda name, value: ~F.col(name).eqNullSafe(value)
    return _master(calendar, "date", {
        "year": off("year", F.year(d)), "month": off("month", F.month(d)), "day": off("day", F.day(d)), "quarter": off("quarter", F.quarter(d)),
        "week_of_year": off("week_of_year", F.weekofyear(d)), "day_of_week": off("day_of_week", F.weekday(d)),
        "is_weekend": off("is_weekend", (F.weekday(d) >= 5).cast("int")), "is_holiday": ~F.coalesce(F.col("is_holiday").isin(0, 1), F.lit(False)),
    })


def sales_rules(sales: DataFrame, stores: DataFrame, skus: DataFrame, calendar: DataFrame) -> DataFrame:
    price = rnd(F.col("units_sold") * F.col("avg_unit_price"), 2)
    row = sales.agg(
        F.count(N).alias("original_rows"), F.count_if(~F.coalesce(F.col("promotion_flag").isin(0, 1), F.lit(False))).alias("invalid_promotion_flags"),
        F.count_if(F.abs(F.col("total_revenue") - price) > 0.01).alias("revenue_mismatch_rows"), F.count_if(F.col("units_sold") == 0).alias("zero_unit_rows"),
    )
    keys = ["date", "store_id", "sku_id"]
    repeated = sales.groupBy(*keys).agg(F.count(N).alias("n")).agg(F.count_if(F.col("n") > 1).alias("x")).select("x").scalar()
    lone = lambda dim, k: orphans(sales, dim, [k], "sales", k).select("orphan_count").scalar()
    row = row.withColumns({
        "duplicate_grain": repeated, "orphan_store_ids": lone(stores, "store_id"), "orphan_sku_ids": lone(skus, "sku_id"), "orphan_dates": lone(calendar, "date"),
    })
    return _verdict(row, ["duplicate_grain", "orphan_store_ids", "orphan_sku_ids", "orphan_dates", "invalid_promotion_flags", "revenue_mismatch_rows"])


def inventory_rules(snapshots: DataFrame, sales: DataFrame) -> DataFrame:
    """Balance equations and the keyed cross-check with the sales fact."""
    own = ["store_id", "sku_id"]
    begin, receipts, sold, end = (F.col(c) for c in ("beginning_inventory", "receipts", "units_sold", "ending_inventory"))
    # the sales of a series travel to its snapshots as one map of days, at most a calendar; snapshots dealt by series stay
    on_day = sales.where(F.col("date").isNotNull()).repartition(*own).groupBy(*own, "date").agg(F.struct(F.collect_list("units_sold").alias("units"), F.count(N).alias("rows")).alias("_sales"))
    by_day = on_day.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("date", "_sales"))).alias("_by_day"))
    pair = snapshots.join(by_day.hint("shuffle_hash"), own, "left").withColumn("_sales", F.col("_by_day")[F.col("date")])
    pairs = F.coalesce(F.col("_sales.rows"), F.lit(1))  # rows that the snapshot and its sales make

    def number(of: Column) -> Column:
        return F.coalesce(F.sum(of).cast("long"), F.lit(0).cast("long"))

    def number_if(bad: Column) -> Column:
        return number(F.when(bad, pairs).otherwise(0))

    met = F.col("_sales").isNotNull()
    row = pair.agg(
        number(pairs).alias("original_rows"), number_if(~F.col("stockout_flag").isin(0, 1)).alias("invalid_stockout_flags"),
        number_if(begin + receipts - sold != end).alias("canonical_equation_mismatch_rows"),
        number_if(end == begin - sold).alias("ending_equals_beginning_minus_sold_rows"),
        number_if((begin - receipts) + receipts - sold == end).alias("derived_balance_ok_rows"),
        number(F.when(met, F.size("_sales.units")).otherwise(0)).alias("cross_checked_rows"),
        number(F.when(met, F.size(F.filter("_sales.units", lambda u: u != sold))).otherwise(0)).alias("cross_sales_mismatch_rows"),
    )
    return row.withColumn("canonical_equation_mismatch_pct", pct("canonical_equation_mismatch_rows", "original_rows"))


def business_rules(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Documented rules as (rule, checked, violations, passed)."""
    inv, sales, ret, canc = (tables[t] for t in ("fact_inventory", "fact_sales", "fact_returns", "fact_cancellations"))
    ok = F.col("inventory_balance_ok")
    end, begin, sold = F.col("ending_inventory"), F.col("beginning_inventory"), F.col("units_sold")

    def checks(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
        aggs, entries = [], {}
        for i, (name, (scope, bad)) in enumerate(rules.items()):
            aggs += [F.count_if(scope).alias(f"c{i}"), F.count_if(scope & bad).alias(f"v{i}")]
            entries[name] = [f"c{i}", f"v{i}"]
        return _stack(df.agg(*aggs), entries, ["checked", "violations"], "rule")

    every = F.lit(True)
    sources = ~F.col("source_dataset").isin("UCI", "SYNTHETIC")
    parts = [
        checks(inv, {
            "inventory_equation_ending_eq_beginning_minus_units_sold": (ok, end != begin - sold),
            "receipts_not_readded_to_ending": (ok & (F.col("receipts") > 0), end == begin + F.col("receipts") - sold),
            "inventory_synthetic_only": (every, F.col("source_dataset") != "SYNTHETIC"),
        }),
        checks(sales, {
            "sales_units_nonnegative": (every, sold < 0), "source_dataset_enum_valid": (every, sources),
            "uci_promotion_flag_null_not_invented": (F.col("source_dataset") == "UCI", F.col("promotion_flag").isNotNull()),
        }),
        checks(ret, {"returns_separated_from_sales": (every, F.col("source_dataset") != "UCI")}),
        checks(canc, {
            "cancellations_separated_from_sales": (every, F.col("source_dataset") != "UCI"),
            "positive_cancellations_preserved": (F.col("revenue_impact") > 0, F.col("cancelled_quantity") <= 0),
        }),
        checks(tables["customer_analytics"], {"customer_analytics_no_null_customer_key": (every, F.col("customer_key").isNull())}),
    ]
    leaky = [c for c in tables["forecast_base"].columns if "lag_" in c or "rolling_" in c or "_ewm_" in c]
    base = tables["forecast_base"].agg(F.count(N).alias("checked")).select(
        F.lit("forecast_base_has_no_lag_rolling_features").alias("rule"), "checked", F.lit(len(leaky)).cast("long").alias("violations")
    )
    return union([*parts, base]).withColumn("passed", F.col("violations") == 0)


def flat_report(parts: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows, columns, exact copies, missing cells and date range per dataset."""
    out = []
    for name, (df, day) in parts.items():
        cells = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
        row = df.agg(
            F.count(N).alias("original_rows"), cells.alias("missing_values"),
            (F.min(F.col(day).cast("date")) if day else F.lit(None).cast("date")).alias("min_date"),
            (F.max(F.col(day).cast("date")) if day else F.lit(None).cast("date")).alias("max_date"),
        )
        copies = duplicates(df, df.columns, name).select("duplicate_rows").scalar()
        out.append(row.withColumns({"dataset": F.lit(name), "columns": F.lit(len(df.columns)), "duplicates_found": copies}))
    return union(out)


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """Per column: type, missing share, distinct values, min and max as text."""
    aggs, entries = [F.count(N).alias("_n")], {}
    for c in df.columns:
        entries[c] = [f"{c}__m", f"{c}__lo", f"{c}__hi"]
        aggs += [F.count_if(F.col(c).isNull()).alias(entries[c][0]), F.min(c).cast("string").alias(entries[c][1]), F.max(c).cast("string").alias(entries[c][2])]
    long = _stack(df.agg(*aggs), entries, ["missing_count", "min_value", "max_value"], "column", ["_n"])
    # distinct values: one (column, value) aggregate instead of one per column
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    distinct = to_long(texts, [], df.columns, "column", "value").where(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count(N).alias("distinct_count"))
    return long.join(distinct, "column", "left").select(
        F.lit(dataset).alias("dataset"), "column", F.col("_n").alias("rows"), "missing_count", pct("missing_count", "_n").alias("missing_pct"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "min_value", "max_value",
    )


def log_checks(log: DataFrame) -> DataFrame:
    q, p, inv = F.col("quantity"), F.col("price"), F.col("invoice")
    return log.agg(
        F.count(N).alias("rows"), F.count_if(F.col("description").isNull()).alias("null_description"), F.count_if(F.col("customer_id").isNull()).alias("null_customer_id"),
        F.count_if(q < 0).alias("negative_quantity"), F.count_if(q == 0).alias("zero_quantity"), F.count_if(p == 0).alias("zero_price"),
        F.count_if(p < 0).alias("negative_price"), F.count_if(inv.startswith("C")).alias("cancellation_lines"),
        F.count_distinct("invoice").alias("invoices"), F.count_distinct("stock_code").alias("products"),
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("country").alias("countries"),
    )


def match_rate(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str]], name: str) -> DataFrame:
    parts = []
    for dim, (df, key) in dims.items():
        counted = fact.groupBy(key).agg(F.count(N).alias("n"))
        hit = counted.join(df.select(key, F.lit(1).alias("_hit")).distinct(), key, "left")
        parts.append(hit.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("_hit")), F.lit(0)).alias("matched")).select(
            F.lit(name).alias("fact"), F.lit(dim).alias("dim"), "rows", "matched", pct("matched", "rows").alias("match_rate_pct"),
        ))
    return union(parts)


def batch_quality(df: DataFrame, required: Sequence[str], grain_keys: Sequence[str], negatives: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """Counters of a feature batch as (check, value); column lists in ``detail``."""
    missing = [c for c in required if c not in df.columns]
    leaky = [c for c in forbidden if c in df.columns]
    present = [c for c in negatives if c in df.columns]
    row = df.agg(
        F.count(N).alias("n_rows"), *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in present],
        *[rnd(F.avg(F.col(c).isNull().cast("double")) * 100.0, 4).alias(f"null_pct_{c}") for c in required if c in df.columns],
    )
    row = row.withColumns({
        "n_duplicates": duplicates(df, grain_keys, "b").select("duplicate_rows").scalar(),
        "missing_required_columns": F.lit(len(missing)), "leakage_columns_present": F.lit(len(leaky)),
    })
    names = row.columns
    return _stack(row.select(*[F.col(c).cast("double").alias(c) for c in names]), {c: [c] for c in names}, ["value"], "check")


def unseen_categories(df: DataFrame, known: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels absent from the reference, and the share of rows carrying them."""
    text = lambda d: to_long(d.select(*[F.col(c).cast("string").alias(c) for c in columns]), [], columns, "column", "level")
    counted = text(df).groupBy("column", "level").agg(F.count(N).alias("n"))
    seen = text(known).distinct().withColumn("_seen", F.lit(True))
    marked = counted.join(seen, ["column", "level"], "left")
    new = F.col("_seen").isNull() & F.col("level").isNotNull()
    return marked.groupBy("column").agg(
        F.count_if(new).alias("n_unseen_levels"), F.coalesce(pct(F.sum(F.when(new, F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)).alias("unseen_rate_pct")
    )


def date_gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jumps of more than one day inside the series with two or more dates."""
    days = df.select(*keys, "date").where(F.col("date").isNotNull()).distinct()
    gap = F.date_diff(F.col("date"), F.lag("date").over(series(keys)))
    per = days.withColumn("_g", gap).groupBy(*keys).agg(F.count(N).alias("_n"), F.count_if(F.col("_g") > 1).alias("_gaps"))
    return per.agg(F.count_if(F.col("_n") >= 2).alias("series_checked"), F.coalesce(F.sum("_gaps"), F.lit(0)).alias("gaps_gt_1_day"))


def status_of(*checks: Column) -> Column:
    """FAIL over WARNING over PASS."""
    any_of = lambda v: reduce(lambda a, b: a | b, [c == v for c in checks])
    return F.when(any_of("FAIL"), "FAIL").when(any_of("WARNING"), "WARNING").otherwise("PASS")


WEEKLY_COLUMNS = ("week", "source_dataset", "product_key", "units_sold")


def weekly_quality(df: DataFrame, source: str = "SYNTHETIC", min_skus: int = 90) -> DataFrame:
    present = [c for c in WEEKLY_COLUMNS if c in df.columns]
    keys = ["week", "product_key"]
    row = df.agg(
        F.count(N).alias("rows"), F.count_if(F.col("source_dataset") != source).alias("unexpected_rows"),
        F.count_if(F.col("week").isNull()).alias("invalid_date_rows"), F.count_if(F.col("units_sold") < 0).alias("negative_rows"),
        F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in present]).alias("_worst_null"), F.count_distinct("product_key").alias("sku_count"),
    )
    # one row per week: bounded by the calendar
    weeks = df.groupBy("week").agg(F.count(N).alias("n"))
    sizes = weeks.agg(F.max_by("n", "week").alias("last"), F.percentile("n", F.lit(0.5)).alias("median")).select(F.struct("last", "median").alias("s")).scalar()
    row = row.withColumns({"duplicate_count": duplicates(df, keys, "w").select("duplicate_rows").scalar(), "_s": sizes})
    row = row.withColumns({"latest_week_rows": F.col("_s.last"), "median_weekly_rows": F.floor("_s.median"), "_median": F.col("_s.median")})
    flag = lambda bad, level: F.when(bad, level).otherwise("PASS")
    checks = {
        "schema_validity": F.lit("PASS" if len(present) == len(WEEKLY_COLUMNS) else "FAIL"), "unexpected_source": flag(F.col("unexpected_rows") > 0, "FAIL"),
        "missing_values": flag(F.col("_worst_null") > 0.05, "WARNING"), "duplicate_records": flag(F.col("duplicate_count") > 0, "FAIL"),
        "invalid_dates": flag(F.col("invalid_date_rows") > 0, "FAIL"), "negative_quantities": flag(F.col("negative_rows") > 0, "FAIL"),
        "sku_coverage": flag(F.col("sku_count") < min_skus, "WARNING"),
        "row_count_anomaly": flag(F.abs(F.col("latest_week_rows") - F.col("_median")) / F.greatest(F.col("_median"), F.lit(1)) > 0.2, "WARNING"),
    }
    return row.withColumns(checks).withColumn("overall_status", status_of(*[F.col(c) for c in checks])).drop("_worst_null", "_s", "_median")


def feature_contract(df: DataFrame, required: Sequence[str], week: str = "week") -> DataFrame:
    """Latest-week null rate and moments per contracted feature, with a status."""
    newest = df.agg(F.max(week).alias("m")).select("m").scalar()
    latest = df.where(F.col(week) == newest)
    have = [c for c in required if c in df.columns]
    aggs, entries = [], {}
    for c in have:
        v = F.col(c).cast("double")
        entries[c] = [f"{c}__{s}" for s in ("null", "mean", "std", "min", "max")]
        made = [rnd(F.avg(v.isNull().cast("double")), 4), rnd(F.avg(v), 4), rnd(F.stddev_samp(v), 4), rnd(F.min(v), 4), rnd(F.max(v), 4)]
        aggs += [m.alias(n) for m, n in zip(made, entries[c])]
    table = _stack(latest.agg(*aggs), entries, ["null_rate", "mean", "std", "min", "max"], "feature")
    table = table.withColumn("status", F.when(F.col("null_rate") > 0.1, "FAIL").when(F.col("null_rate") > 0, "WARNING").otherwise("PASS"))
    absent = [c for c in required if c not in df.columns]
    if absent:
        lost = df.sparkSession.createDataFrame([(c, "FAIL") for c in absent], "feature string, status string")
        table = table.unionByName(lost, allowMissingColumns=True)
    return table


def feature_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs, entries = [F.count(N).alias("_n")], {}
    for c in columns:
        v = F.col(c).cast("double")
        finite = F.when(F.abs(v) != F.lit(float("inf")), v)
        entries[c] = [f"{c}__{s}" for s in ("miss", "inf", "min", "max")]
        made = [F.count_if(v.isNull()), F.count_if(F.abs(v) == F.lit(float("inf"))), rnd(F.min(finite), 6), rnd(F.max(finite), 6)]
        aggs += [m.alias(n) for m, n in zip(made, entries[c])]
    long = _stack(df.agg(*aggs), entries, ["missing_count", "infinite_count", "min_value", "max_value"], "feature", ["_n"])
    values = to_long(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns, "feature", "v")
    distinct = values.where(F.col("v").isNotNull()).distinct().groupBy("feature").agg(F.count(N).alias("distinct_count"))
    return long.join(distinct, "feature", "left").select(
        "feature", pct("missing_count", "_n").alias("missing_pct"), "missing_count", "infinite_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "min_value", "max_value",
    )


def leakage_checks(features: DataFrame, keys: Sequence[str], lags: Sequence[int], windows: Sequence[int]) -> DataFrame:
    """Recompute lags and trailing means of *all* rows from row positions.

    Not through the window expressions under test: each row sends its value, and the sum of its series up to it, to
    the positions that should know them, and what arrives at a position is compared with what stands there. A row
    sends as many values as there are lags and windows, whatever the length of its series, and a series is spread over
    its positions. Null keys are keys.
    """
    keys, w = list(keys), series(keys)
    y = F.col("units_sold").cast("double")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = features.select(
        *keys, (F.row_number().over(w) - 1).alias("_i"), y.alias("_y"), F.sum(F.coalesce(y, F.lit(0.0))).over(upto).alias("_s"),
        *[F.col(f"units_sold_lag_{k}").cast("double").alias(f"l{k}") for k in lags], *[F.col(f"rolling_mean_{k}").alias(f"r{k}") for k in windows],
    )
    rows = stored(rows, "positions")
    offsets = sorted({1, *lags, *[1 + k for k in windows]})
    sent = rows.withColumn("_o", F.explode(F.array(*map(F.lit, offsets)))).select(*keys, (F.col("_i") + F.col("_o")).alias("_i"), "_o", F.col("_y").alias("_sent"), F.col("_s").alias("_sum"))
    here = rows.select(*keys, "_i", F.lit(0).alias("_o"), *[c for c in rows.columns if c[0] in "lr" and c[1:].isdigit()])
    at = here.unionByName(sent, allowMissingColumns=True)
    own = [c for c in here.columns if c not in (*keys, "_i", "_o")]
    pick = lambda c, o: F.max(F.when(F.col("_o") == o, F.col(c)))
    met = at.groupBy(*keys, "_i").agg(
        *[pick(c, 0).alias(c) for c in own], *[pick("_sent", k).alias(f"y{k}") for k in lags],
        pick("_sum", 1).alias("s0"), *[pick("_sum", 1 + k).alias(f"s{k}") for k in windows], F.count_if(F.col("_o") == 0).alias("_here"),
    ).where(F.col("_here") > 0)
    i = F.col("_i")
    differs = lambda a, b: F.coalesce(~(a.eqNullSafe(b) | (F.abs(a - b) <= 1e-6)), F.lit(True))
    rules = {"first_row_has_history": (i == 0) & F.col(f"l{min(lags)}").isNotNull()}
    for k in lags:
        rules[f"lag_{k}_mismatch"] = differs(F.col(f"l{k}"), F.col(f"y{k}"))
    for k in windows:
        mean = (F.col("s0") - F.coalesce(f"s{k}", F.lit(0.0))) / F.nullif(F.least(i, F.lit(k)), F.lit(0))
        rules[f"rolling_mean_{k}_mismatch"] = differs(F.col(f"r{k}"), mean)
    row = met.agg(F.count(N).alias("rows"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    return _stack(row, {n: ["rows", n] for n in rules}, ["rows_checked", "violations"], "check")


def split_order(df: DataFrame) -> DataFrame:
    """Training days end before validation days begin, and those before test."""
    at = lambda s, f: f(F.when(F.col("split") == s, F.col("date")))
    t = df.groupBy("source_dataset").agg(
        at("train", F.max).alias("train_end"), at("validation", F.min).alias("val_start"), at("validation", F.max).alias("val_end"), at("test", F.min).alias("test_start")
    )
    return t.withColumn("ordered", (F.col("train_end") < F.col("val_start")) & (F.col("val_end") < F.col("test_start")))


def inference_contract(df: DataFrame, dataset: str, horizon: int, numeric: Sequence[str], negatives: Sequence[str]) -> DataFrame:
    """Violation counts of a scoring batch."""
    key = ["date", "source_dataset", "entity_id", "product_key"]
    row = df.agg(
        F.count(N).alias("rows"), F.count_if(F.col("source_dataset") != dataset).alias("wrong_source"), F.count_if(F.col("horizon") != horizon).alias("wrong_horizon"),
        F.count_if(F.col("units_sold_lag_1").isNull()).alias("missing_lag_1"),
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"non_numeric_{c}") for c in numeric],
        *[F.count_if(F.col(c).try_cast("double") < 0).alias(f"negative_{c}") for c in negatives],
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in df.columns if c.startswith("hcal_")],
    ).withColumn("duplicate_keys", duplicates(df, key, "i").select("duplicate_rows").scalar())
    names = [c for c in row.columns if c != "rows"]
    return _stack(row.select(*[F.col(c).cast("long").alias(c) for c in row.columns]), {c: [c] for c in names}, ["violations"], "check", ["rows"])


# Fields a caller may not send, and features that cannot be negative.
FORBIDDEN_FIELDS = ("model_file", "model_path", "model_dir", "joblib", "filepath", "file_path", "__file__", "registry_path")
LEAKAGE_FIELDS = ("revenue", "transaction_count", "unique_customers")
NON_FINITE = ("nan", "inf", "+inf", "-inf", "infinity", "-infinity")
NON_NEGATIVE = (
    "units_sold_lag_1", "units_sold_lag_2", "units_sold_lag_3", "units_sold_lag_7", "units_sold_lag_14", "units_sold_lag_21",
    "units_sold_lag_28", "units_sold_lag_30", "rolling_mean_7", "rolling_mean_14", "rolling_mean_30", "average_unit_price",
    "price_lag_1", "base_price",
)


def validate_records(records: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """First reason to reject each record, NULL for a valid one.

    ``features`` is a map<string,string>; copies of a key are found by counting
    keys, not by gathering them.
    """
    names = F.map_keys(features)
    values = F.transform(F.map_values(features), lambda v: F.lower(F.trim(v)))
    folder = lambda c: F.replace(F.lower(F.col(c)), F.lit("\\"), F.lit("/")).contains("models/final")
    bad_path = lambda c: F.col(c).contains("..") | F.col(c).contains("\0") | F.lower(F.col(c)).rlike(r"\.(joblib|pkl)$") | folder(c) | (F.trim(F.col(c)) == "")
    no_day = F.exists(F.map_entries(features), lambda e: e["key"].startswith("hcal_") & e["value"].isNull())
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.element_at(features, c).try_cast("double") < 0, F.lit(False)) for c in NON_NEGATIVE])
    copies = records.groupBy(*keys).agg(F.count(N).alias("_copies"))
    rows = records.join(copies, list(keys), "left")
    reason = (
        F.when(F.arrays_overlap(names, F.array(*[F.lit(x) for x in FORBIDDEN_FIELDS])), "forbidden_field")
        .when(F.arrays_overlap(names, F.array(*[F.lit(x) for x in LEAKAGE_FIELDS])), "leakage_column")
        .when(F.exists(values, lambda v: v.isin(*NON_FINITE)), "non_finite_value")
        .when(F.exists(values, lambda v: v.startswith("{") | v.startswith("[")), "nested_value")
        .when(negative, "negative_value").when(F.element_at(features, "units_sold_lag_1").isNull(), "missing_lag_1")
        .when(no_day, "missing_calendar").when(bad_path("entity_id") | bad_path("product_key"), "invalid_key").when(F.col("date").isNull(), "invalid_date")
        .when(F.col("_copies") > 1, "duplicate_key")
    )
    return rows.withColumn("reason", reason).drop("_copies")


def frame_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys on one side only, and value differences beyond the tolerance."""
    a = left.select(*keys, *[F.col(v).cast("double").alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(v).cast("double").alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "outer")

    def off(v: str) -> Column:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        near = F.abs(x - y) <= tolerance + tolerance * F.abs(y)
        return ~(x.eqNullSafe(y) | F.coalesce(near, F.lit(False)))

    matched = F.col("_a") & F.col("_b")
    table = both.agg(
        F.count_if(F.coalesce(matched, F.lit(False))).alias("matched_rows"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
        *[F.count_if(F.coalesce(matched, F.lit(False)) & off(v)).alias(f"differs_{v}") for v in values],
    )
    bad = reduce(lambda x, y: x + y, [F.col(c) for c in table.columns if c != "matched_rows"])
    return table.withColumn("equal", bad == 0)
