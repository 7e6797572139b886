"""Star-schema builders: dimensions, facts and derived marts of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.functions.semantics import distinct_of, most_common, ratio, week_start, with_ordinals, zero_sum
from demandloom.functions.vocabulary import ONLINE, SYNTHETIC, UCI
from demandloom.operators import cleaning, features


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def keyed(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# ---- dimensions -------------------------------------------------------------
def dim_calendar(calendar: DataFrame, lines: DataFrame) -> DataFrame:
    """Base calendar plus the online days it lacks; no holidays are invented."""
    sales = cleaning.split(lines, "SALE")
    span = sales.agg(F.min("invoice_date_only").alias("lo"), F.max("invoice_date_only").alias("hi"))
    days = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
    derived = features.calendar_attributes(days, {}).withColumns(
        {"holiday_name": _null("string"), "date_source": F.lit("UCI_DERIVED")}
    )
    base = calendar.withColumn("date_source", F.lit(SYNTHETIC))
    missing = derived.join(base.select("date"), "date", "left_anti")
    return base.unionByName(missing)


def dim_product(sku_master: DataFrame, lines: DataFrame) -> DataFrame:
    attributes = [
        "category", "sub_category", "brand", "cost_price", "base_price", "weight_kg",
        "supplier_id", "lead_time_days", "reorder_point", "safety_stock",
    ]
    syn = sku_master.select(
        keyed("SYN_", "sku_id").alias("product_key"), F.lit(SYNTHETIC).alias("source_dataset"),
        "sku_id", F.col("sku_name").alias("product_name"), *attributes,
    )
    described = lines.where(F.col("transaction_type").isin("SALE", "RETURN", "CANCELLATION"))
    online = most_common(described.select("stock_code", "description"), "stock_code", "description").select(
        keyed("UCI_", "stock_code").alias("product_key"), F.lit(UCI).alias("source_dataset"),
        F.col("stock_code").alias("sku_id"), F.col("description").alias("product_name"),
    )
    return syn.unionByName(online, allowMissingColumns=True)


def dim_entity(store_master: DataFrame) -> DataFrame:
    stores = store_master.select(
        F.col("store_id").alias("entity_id"), F.lit("STORE").alias("entity_type"),
        F.lit(SYNTHETIC).alias("source_dataset"), "store_name", "city", "state", "region", "store_type",
        F.col("store_size_sqft").cast("double").alias("store_size_sqft"), "opening_date",
    )
    channel = store_master.sparkSession.range(1).select(
        F.lit(ONLINE).alias("entity_id"), F.lit("CHANNEL").alias("entity_type"), F.lit(UCI).alias("source_dataset")
    )
    return stores.unionByName(channel, allowMissingColumns=True)


def _identified_country(lines: DataFrame) -> DataFrame:
    sales = cleaning.split(lines, "SALE").where(F.col("customer_id").isNotNull())
    return most_common(sales.select(F.col("customer_id").cast("string"), "country"), "customer_id", "country")


def dim_customer(customer_master: DataFrame, lines: DataFrame) -> DataFrame:
    master = customer_master.select(
        keyed("SYN_", "customer_id").alias("customer_key"), F.lit(SYNTHETIC).alias("source_dataset"),
        "customer_id", "customer_name", "customer_segment", "loyalty_member", "signup_date",
    )
    online = _identified_country(lines).select(
        keyed("UCI_", "customer_id").alias("customer_key"), F.lit(UCI).alias("source_dataset"), "customer_id", "country"
    )
    return master.unionByName(online, allowMissingColumns=True).withColumn("is_guest_transaction", F.lit(False))


# ---- facts ------------------------------------------------------------------
def _online_keys() -> list[Column]:
    return [
        F.col("invoice_date_only").alias("date"), F.lit(UCI).alias("source_dataset"), F.lit(ONLINE).alias("entity_id"),
        F.lit("CHANNEL").alias("entity_type"), keyed("UCI_", "stock_code").alias("product_key"),
        F.col("stock_code").alias("sku_id"),
    ]


def online_sales(lines: DataFrame) -> DataFrame:
    """Date x stock code; a guest line sells units but is no identified customer."""
    grain = ["invoice_date_only", "stock_code"]
    sales = cleaning.split(lines, "SALE").select(*grain, "quantity", "price", "invoice", "customer_id")
    daily = with_ordinals(sales, grain, ["invoice", "customer_id"]).groupBy(*grain).agg(
        F.sum("quantity").alias("units_sold"), F.sum(F.col("quantity") * F.col("price")).alias("revenue"),
        distinct_of("invoice").alias("transaction_count"),
        distinct_of("customer_id").alias("unique_customers"),
    )
    return daily.select(
        *_online_keys(), F.col("units_sold").cast("long").alias("units_sold"), "revenue",
        ratio("revenue", "units_sold").alias("average_unit_price"), "transaction_count", "unique_customers",
        _null("int").alias("promotion_flag"),
    )


def store_sales(sales_daily: DataFrame) -> DataFrame:
    return sales_daily.select(
        "date", F.lit(SYNTHETIC).alias("source_dataset"), F.col("store_id").alias("entity_id"),
        F.lit("STORE").alias("entity_type"), keyed("SYN_", "sku_id").alias("product_key"), "sku_id", "units_sold",
        F.col("total_revenue").alias("revenue"), F.col("avg_unit_price").alias("average_unit_price"),
        "transaction_count", "unique_customers", "promotion_flag",
    )


def fact_sales(lines: DataFrame, sales_daily: DataFrame) -> DataFrame:
    return online_sales(lines).unionByName(store_sales(sales_daily))


def fact_inventory(balanced: DataFrame) -> DataFrame:
    return balanced.select(
        "date", F.lit(SYNTHETIC).alias("source_dataset"), F.col("store_id").alias("entity_id"),
        keyed("SYN_", "sku_id").alias("product_key"), "sku_id", "beginning_inventory",
        "beginning_inventory_pre_receipts", "receipts", "units_sold", "ending_inventory", "stockout_flag",
        "on_order_qty", "inventory_balance_ok",
    )


def _reversals(lines: DataFrame, kind: str, quantity: str, count: str) -> DataFrame:
    daily = cleaning.split(lines, kind).groupBy("invoice_date_only", "stock_code").agg(
        F.sum(F.abs("quantity")).alias(quantity), F.count_distinct("invoice").alias(count),
        F.sum(F.col("quantity") * F.col("price")).alias("revenue_impact"),
    )
    return daily.select(*_online_keys(), quantity, count, "revenue_impact")


def fact_returns(lines: DataFrame) -> DataFrame:
    return _reversals(lines, "RETURN", "quantity_returned", "return_transactions")


def fact_cancellations(lines: DataFrame) -> DataFrame:
    return _reversals(lines, "CANCELLATION", "cancelled_quantity", "cancellation_transactions")


# ---- marts ------------------------------------------------------------------
def customer_analytics(customer_master: DataFrame, lines: DataFrame) -> DataFrame:
    sales = cleaning.split(lines, "SALE").where(F.col("customer_id").isNotNull())
    totals = sales.groupBy(F.col("customer_id").cast("string").alias("customer_id")).agg(
        F.count_distinct("invoice").alias("transaction_count"), F.sum("quantity").cast("long").alias("total_units"),
        F.sum(F.col("quantity") * F.col("price")).alias("total_revenue"),
        F.min("invoice_date_only").alias("first_purchase_date"), F.max("invoice_date_only").alias("last_purchase_date"),
    )
    online = totals.join(_identified_country(lines), "customer_id", "left").select(
        keyed("UCI_", "customer_id").alias("customer_key"), F.lit(UCI).alias("source_dataset"), "*"
    )
    master = customer_master.select(
        keyed("SYN_", "customer_id").alias("customer_key"), F.lit(SYNTHETIC).alias("source_dataset"),
        "customer_id", "customer_segment", "loyalty_member", "signup_date",
    )
    return online.unionByName(master, allowMissingColumns=True)


def inventory_analytics(inventory: DataFrame, products: DataFrame) -> DataFrame:
    attributes = products.select(
        "product_key", "category", "sub_category", "brand", "lead_time_days", "reorder_point", "safety_stock"
    )
    return inventory.join(attributes, "product_key", "left").select(
        "date", "source_dataset", "entity_id", "product_key", "sku_id", "category", "sub_category", "brand",
        "ending_inventory", "on_order_qty", "stockout_flag", "lead_time_days", "reorder_point", "safety_stock",
    )


def forecast_base(sales: DataFrame) -> DataFrame:
    return sales.select(
        "date", "source_dataset", "entity_id", "entity_type", "product_key", "sku_id", "units_sold", "revenue",
        "average_unit_price", "transaction_count", "unique_customers", "promotion_flag",
    )


def wide_model(sales, inventory, skus, stores, calendar, start=None, end=None, stores_kept=None, skus_kept=None) -> DataFrame:
    """Sales with matching inventory and all attributes, margins and stock value."""
    for bound, test in ((start, "ge"), (end, "le")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            keep = F.col("date") >= day if test == "ge" else F.col("date") <= day
            sales, inventory = sales.where(keep), inventory.where(keep)
    for dim, key, count in ((stores, "store_id", stores_kept), (skus, "sku_id", skus_kept)):
        if count is not None:
            chosen = dim.select(key).orderBy(key).limit(count)
            sales = sales.join(chosen, key, "left_semi")
            inventory = inventory.join(chosen, key, "left_semi")
    grain = ["date", "store_id", "sku_id"]
    stock = inventory.withColumnRenamed("units_sold", "units_sold_inv")
    joined = (
        sales.join(stock, grain)
        .join(skus.drop("weight_kg", "supplier_id"), "sku_id", "left")
        .join(stores.select("store_id", "store_name", "city", "state", "region", "store_type"), "store_id", "left")
        .join(calendar.select("date", "year", "month", "quarter", "day_of_week", "day_name", "is_weekend", "is_holiday", "season"), "date", "left")
    )
    cogs = F.col("units_sold") * F.col("cost_price")
    profit = F.col("total_revenue") - cogs
    return joined.withColumns({
        "cogs": cogs,
        "gross_profit": profit,
        "margin_pct": F.when(F.col("total_revenue") > 0, profit / F.col("total_revenue")).otherwise(0.0),
        "ending_inventory_value": F.col("ending_inventory") * F.col("cost_price"),
        "is_stockout": (F.col("stockout_flag") == 1) | (F.col("ending_inventory") == 0),
    })


# ---- adapters and coarser grains ---------------------------------------------
def legacy_sales(base: DataFrame, source: str | None = None) -> DataFrame:
    rows = base if source is None else base.where(F.col("source_dataset") == source)
    return rows.select(
        "date", F.col("entity_id").alias("store_id"), "sku_id", "units_sold", F.col("revenue").alias("total_revenue"),
        F.col("average_unit_price").alias("avg_unit_price"), "transaction_count", "unique_customers", "promotion_flag",
    )


def daily_at_grain(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser daily grain; price is revenue per unit, else the group's median price."""
    daily = sales.groupBy("date", *keys).agg(
        F.sum("units_sold").alias("units_sold"), F.sum("total_revenue").alias("total_revenue"),
        F.max("promotion_flag").alias("promotion_flag"),
    ).withColumn("avg_unit_price", ratio("total_revenue", "units_sold"))
    # one row per group and day, so a group's buffer is bounded by the calendar
    medians = daily.groupBy(*keys).agg(F.percentile("avg_unit_price", F.lit(0.5)).alias("_median"))
    return daily.join(medians, keys, "left").withColumn(
        "avg_unit_price", F.coalesce("avg_unit_price", "_median")
    ).drop("_median")


def weekly_online(log: DataFrame) -> DataFrame:
    grain = ["week", "product_key"]
    sales = cleaning.sale_lines(log).select(
        week_start(F.col("invoice_date").cast("date")).alias("week"), keyed("UCI_", "stock_code").alias("product_key"),
        "quantity", "price", "invoice", "customer_id")
    weekly = with_ordinals(sales, grain, ["invoice", "customer_id"]).groupBy(*grain).agg(
        F.sum("quantity").cast("long").alias("units_sold"), F.sum(F.col("quantity") * F.col("price")).alias("revenue"),
        F.avg("price").alias("avg_unit_price"), distinct_of("invoice").alias("transaction_count"),
        distinct_of("customer_id").alias("unique_customers"),
    )
    return weekly.where(F.col("units_sold") > 0).withColumn("source_dataset", F.lit(UCI))


def weekly_sku(sales_daily: DataFrame) -> DataFrame:
    return sales_daily.groupBy(
        week_start("date").alias("week"), keyed("SYN_", "sku_id").alias("product_key")
    ).agg(
        F.sum("units_sold").alias("units_sold"), F.sum("total_revenue").alias("revenue"),
        F.avg("avg_unit_price").alias("avg_unit_price"), F.sum("transaction_count").alias("transaction_count"),
        F.sum("unique_customers").alias("unique_customers"), F.max("promotion_flag").alias("promotion_flag"),
        F.count_distinct("store_id").alias("store_count"),
    ).withColumn("source_dataset", F.lit(SYNTHETIC))


def weekly_store_sku(sales: DataFrame) -> DataFrame:
    return sales.groupBy(week_start("date").alias("week"), "store_id", "sku_id").agg(
        F.sum("units_sold").alias("units_sold"), F.sum("total_revenue").alias("revenue"),
        F.avg("avg_unit_price").alias("avg_unit_price"), F.max("promotion_flag").alias("promotion_flag"),
    ).withColumn("source_dataset", F.lit(SYNTHETIC))


def weekly_inventory(snapshots: DataFrame) -> DataFrame:
    """Last non-null value of each measure within the week."""
    measures = ["beginning_inventory", "receipts", "units_sold", "ending_inventory", "stockout_flag", "on_order_qty"]
    return snapshots.groupBy(week_start("date").alias("week"), "store_id", "sku_id").agg(
        *[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("date"))).alias(m) for m in measures]
    )


def weekly_calendar(calendar: DataFrame) -> DataFrame:
    named = F.when(F.col("holiday_name") != "Regular Day", F.col("holiday_name"))
    weekly = calendar.groupBy(week_start("date").alias("week")).agg(
        F.max("is_holiday").alias("is_holiday_week"), F.sum("is_holiday").alias("holiday_count"),
        F.array_join(F.array_sort(F.collect_set(named)), ", ").alias("holiday_names"),
        F.min_by("season", "date").alias("season"), F.min_by("month", "date").alias("month"),
    )
    return weekly.withColumns({
        f"season_{s}": (F.col("season") == s).cast("int") for s in ("Winter", "Spring", "Summer", "Fall")
    })
