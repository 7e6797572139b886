"""Retail tables derived lazily from the order, part and event tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.semantics import distinct_of, series, week_start, with_ordinals
from demandloom.functions.vocabulary import HORIZONS
from demandloom.operators import backtest, baselines, cleaning, features, risk, star
from demandloom.session import stored

# (name, month, ISO weekday or None, first day, last day): a weekday within a week of days is its nth of the month
HOLIDAYS = (
    ("First Day of Year", 1, None, 1, 1),
    ("Spring Bank Day", 5, 1, 25, 31),
    ("Midsummer Sale", 6, 5, 19, 25),
    ("Labor Day", 9, 1, 1, 7),
    ("Harvest Thursday", 11, 4, 22, 28),
    ("Sale Friday", 11, 5, 23, 29),
    ("Winter Holidays", 12, None, 24, 26),
    ("Last Day of Year", 12, None, 31, 31),
)
PANEL_ROWS = 1_000_000  # of the panel, zeros included, in a partition: sorted in memory


class Retail:
    """Tables of one query. The raw ones and the panel are written once when first asked for, as sources would be; all others are plans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- raw sources -------------------------------------------------------
    @cached_property
    def retail_log(self) -> DataFrame:
        """Transaction lines with cancellations, returns, gaps and exact copies."""
        line, orders = self.table("lineitem"), self.table("orders")
        part, customer, nation = self.table("part"), self.table("customer"), self.table("nation")
        # the orders find their country first, so that the lines travel only to their order and their part
        buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        sold = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "n_name")
        rows = line.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        order_id = F.col("l_orderkey").cast("string")
        cancelled = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        adjusted = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7) & (F.col("l_tax") >= 0.07)
        returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
        copies = F.when(F.col("l_partkey") % 31 == 0, 2).otherwise(1)
        made = rows.select(
            F.when(cancelled, F.concat(F.lit("C"), order_id)).when(adjusted, F.concat(F.lit("A"), order_id))
            .otherwise(order_id).alias("invoice"),
            F.col("l_partkey").cast("string").alias("stock_code"),
            F.when((F.col("l_linenumber") == 6) | (F.col("l_partkey") % 97 == 13), None)
            .when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type"))
            .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("description"),
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            F.col("l_shipdate").alias("invoice_date"),
            F.when((F.col("l_tax") == 0.08) & (F.col("l_linenumber") == 5), F.lit(0.0))
            .when((F.col("l_tax") == 0.08) & (F.col("l_linenumber") == 7), F.lit(-1.0))
            .otherwise(F.col("p_retailprice")).alias("price"),
            F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("customer_id"),
            F.col("n_name").alias("country"),
            F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
        ).drop("_copy")
        return stored(made, "retail-log")

    @cached_property
    def store_master(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.concat(F.lit("STORE_"), F.col("s_suppkey").cast("string")).alias("store_id"),
                F.col("s_name").alias("store_name"), F.col("n_name").alias("city"),
                F.lit(None).cast("string").alias("state"), F.col("r_name").alias("region"),
                F.when(F.col("s_suppkey") % 2 == 0, "Standard").otherwise("Express").alias("store_type"),
                F.when(F.col("s_acctbal") < 0, 0).otherwise(15000 + (F.col("s_suppkey") % 40) * 250)
                .cast("int").alias("store_size_sqft"),
                F.date_add(F.lit("1994-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")).alias("opening_date"),
            )
        )

    @cached_property
    def sku_master(self) -> DataFrame:
        """One SKU per brand: the product line the stores sell."""
        no = F.regexp_replace("p_brand", "Brand#", "").cast("int")
        per_brand = self.table("part").groupBy(no.alias("no"), "p_brand").agg(
            F.count(F.lit(1)).alias("n"), F.min("p_name").alias("sku_name"),
            F.max("p_retailprice").alias("base_price"), F.max("p_size").alias("size"),
        )
        return per_brand.select(
            F.concat(F.lit("SKU_"), F.col("no").cast("string")).alias("sku_id"), "sku_name",
            F.when(F.col("no") != 19, F.concat(F.lit("CAT_"), (F.col("no") % 6).cast("string"))).alias("category"),
            F.concat(F.lit("SUB_"), (F.col("no") % 9).cast("string")).alias("sub_category"),
            F.col("p_brand").alias("brand"),
            (F.col("base_price") * F.when(F.col("no") == 13, 1.1).otherwise(0.6)).alias("cost_price"),
            "base_price", (F.col("size") / 10.0).alias("weight_kg"),
            F.concat(F.lit("SUP_"), (F.col("no") % 7).cast("string")).alias("supplier_id"),
            (3 + (F.col("no") * 4) % 25).cast("int").alias("lead_time_days"),
            (20 + (F.col("no") * 11) % 60).cast("int").alias("reorder_point"),
            (8 + (F.col("no") * 3) % 20).cast("int").alias("safety_stock"),
        )

    @cached_property
    def customer_master(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.when(segment == "HOUSEHOLD", "Consumer").when(segment == "AUTOMOBILE", "Corporate")
            .when(segment == "BUILDING", "Small Business").when(segment == "FURNITURE", "VIP Loyalty")
            .otherwise(segment).alias("customer_segment"),
            F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") >= 0, 0).alias("loyalty_member"),
            F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("signup_date"),
        )

    @cached_property
    def sales_daily(self) -> DataFrame:
        """Store x SKU x day; one shuffle on the grain after the part lookup."""
        line, orders, part = self.table("lineitem"), self.table("orders"), self.table("part")
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        keys = ["date", "l_suppkey", "sku_id"]
        rows = (
            line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_shipdate").cast("date").alias("date"), "l_suppkey",
                F.regexp_replace("p_brand", "Brand#", "SKU_").alias("sku_id"),
                "l_quantity", net.alias("net"), "l_orderkey", "o_custkey", (F.col("l_discount") >= 0.08).alias("promoted"),
            )
        )
        made = (
            with_ordinals(rows, keys, ["l_orderkey", "o_custkey"])
            .groupBy(*keys)
            .agg(
                F.sum("l_quantity").cast("long").alias("units_sold"), F.sum("net").alias("total_revenue"),
                (F.sum("net") / F.nullif(F.sum("l_quantity"), F.lit(0.0))).alias("avg_unit_price"),
                distinct_of("l_orderkey").alias("transaction_count"),
                distinct_of("o_custkey").alias("unique_customers"),
                F.max(F.when(F.col("promoted"), 1).otherwise(0)).alias("promotion_flag"),
            )
        ).select("date", F.concat(F.lit("STORE_"), F.col("l_suppkey").cast("string")).alias("store_id"), "sku_id", "units_sold", "total_revenue", "avg_unit_price",
                 "transaction_count", "unique_customers", "promotion_flag")
        return stored(made, "sales-daily")

    @cached_property
    def daily_units(self) -> DataFrame:
        """Store x SKU x day measures that need no order lookup."""
        line, part = self.table("lineitem"), self.table("part")
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        made = (
            line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(
                F.col("l_shipdate").cast("date").alias("date"),
                F.concat(F.lit("STORE_"), F.col("l_suppkey").cast("string")).alias("store_id"),
                F.regexp_replace("p_brand", "Brand#", "SKU_").alias("sku_id"),
            )
            .agg(
                F.sum("l_quantity").cast("long").alias("units_sold"), F.sum(net).alias("total_revenue"),
                F.max(F.when(F.col("l_discount") >= 0.08, 1).otherwise(0)).alias("promotion_flag"),
                (1 - F.sum(net) / F.nullif(F.sum("l_extendedprice"), F.lit(0.0))).alias("discount_pct"),
            )
        )
        return stored(made, "daily-units")

    @cached_property
    def date_span(self) -> DataFrame:
        d = F.col("l_shipdate").cast("date")
        return self.table("lineitem").agg(F.min(d).alias("lo"), F.max(d).alias("hi"))

    @cached_property
    def calendar(self) -> DataFrame:
        days = self.date_span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
        return features.calendar_attributes(days, HOLIDAYS)

    @cached_property
    def sales_weeks(self) -> DataFrame:
        """Store x SKU x week with sales, and the weeks of the zero-filled panel that each stands for."""
        keys = ["store_id", "sku_id"]
        weekly = self.daily_units.repartition(*keys).groupBy(*keys, week_start("date").alias("date")).agg(
            F.sum("units_sold").alias("units_sold"), F.sum("total_revenue").alias("total_revenue"),
            F.max("promotion_flag").alias("promotion_flag"),
        )
        span = self.date_span.select(week_start("lo").alias("lo"), week_start("hi").alias("hi"))
        return baselines.with_gaps(weekly, keys, "date", span, 7)

    @cached_property
    def sales_grid(self) -> DataFrame:
        """Zero-filled store x SKU x week panel, one row per series and week."""
        return baselines.fill_gaps(self.sales_weeks, ["store_id", "sku_id"], "date", 7, ["units_sold", "total_revenue", "promotion_flag"])

    @cached_property
    def inventory_snapshots(self) -> DataFrame:
        """Snapshot of a series on every sales day and on the last day of every week."""
        keys, own = ["date", "store_id", "sku_id"], ["store_id", "sku_id"]
        span, units = self.date_span.select("lo", "hi", week_start("lo").alias("lo_week"), week_start("hi").alias("hi_week")), F.col("units_sold")
        lo_week, hi, hi_week = (span.select(c).scalar() for c in ("lo_week", "hi", "hi_week"))
        # a sales day emits itself and the week ends up to the next one, the first one also those before it: one row for
        # each sale is dealt by series, and the snapshots stay where their series is
        w, day = series(own), F.col("date")
        bounds = self.daily_units.select(*keys, "units_sold").withColumns({"_first": F.row_number().over(w) == 1, "_next": F.lead("date").over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
        bounds = bounds.withColumns({"_from": F.when(F.col("_first"), lo_week).otherwise(week_start(day)), "_to": F.when(F.col("_last"), hi_week).otherwise(F.date_sub(week_start("_next"), 7))})
        is_end = F.coalesce((day == F.date_add(week_start(day), 6)) | (day == hi), F.lit(False))
        none = F.array().cast("array<date>")
        ends = F.when(F.col("_from") <= F.col("_to"), F.sequence(F.date_add("_from", 6), F.date_add("_to", 6), F.expr("interval 7 days"))).otherwise(none)
        days = F.concat(F.when(is_end, none).otherwise(F.array(day)), ends)
        rows = bounds.select(*own, day.alias("_day"), F.when(is_end, F.greatest(units, F.lit(0))).otherwise(units).alias("_units"), hi.alias("_hi"), F.explode(days).alias("date"))
        rows = rows.withColumn("date", F.when(F.col("date") > F.col("_hi"), F.col("_hi")).otherwise(F.col("date")))
        rows = rows.select(*keys, F.when(F.col("date").eqNullSafe(F.col("_day")), F.col("_units")).otherwise(F.lit(0).cast("long")).alias("units_sold"))
        begin = (
            F.day("date") * 7 + F.month("date") * 5
            + F.substring("sku_id", 5, 10).cast("int") * 11 + F.substring("store_id", 7, 10).cast("int") * 13
        ) % 90
        rows = rows.select(
            *keys, begin.cast("long").alias("beginning_inventory"),
            F.when(F.day("date") % 7 == 0, 30).otherwise(0).cast("long").alias("receipts"), "units_sold",
        )
        return rows.withColumns({
            "ending_inventory": F.greatest(F.col("beginning_inventory") - F.col("units_sold"), F.lit(0)),
            "stockout_flag": F.when(F.col("units_sold") > F.col("beginning_inventory"), 1).otherwise(0),
            "on_order_qty": F.when(F.day("date") % 3 == 0, 40).otherwise(0),
        })

    # ---- cleaned and modelled tables ---------------------------------------
    @cached_property
    def clean_lines(self) -> DataFrame:
        return cleaning.clean_transactions(self.retail_log)

    @cached_property
    def dim_calendar(self) -> DataFrame:
        return star.dim_calendar(self.calendar, self.clean_lines)

    @cached_property
    def dim_product(self) -> DataFrame:
        return star.dim_product(self.sku_master, self.clean_lines)

    @cached_property
    def dim_entity(self) -> DataFrame:
        return star.dim_entity(self.store_master)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return star.dim_customer(self.customer_master, self.clean_lines)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return star.fact_sales(self.clean_lines, self.sales_daily)

    @cached_property
    def fact_inventory(self) -> DataFrame:
        return star.fact_inventory(cleaning.inventory_balance(self.inventory_snapshots))

    @cached_property
    def fact_returns(self) -> DataFrame:
        return star.fact_returns(self.clean_lines)

    @cached_property
    def fact_cancellations(self) -> DataFrame:
        return star.fact_cancellations(self.clean_lines)

    @cached_property
    def customer_analytics(self) -> DataFrame:
        return star.customer_analytics(self.customer_master, self.clean_lines)

    @cached_property
    def inventory_analytics(self) -> DataFrame:
        return star.inventory_analytics(self.fact_inventory, self.dim_product)

    @cached_property
    def forecast_base(self) -> DataFrame:
        return star.forecast_base(self.fact_sales)

    @cached_property
    def weekly_demand(self) -> DataFrame:
        """SKU-week demand of both sources."""
        return star.weekly_online(self.retail_log).unionByName(
            star.weekly_sku(self.sales_daily), allowMissingColumns=True
        )

    @cached_property
    def weekly_calendar(self) -> DataFrame:
        return star.weekly_calendar(self.calendar)

    @cached_property
    def observed(self) -> DataFrame:
        """Rows of ``panel`` with sales, and the weeks that each stands for in the dense series."""
        keep = [*features.GRAIN, "date", "units_sold", "revenue"]
        syn = self.sales_weeks.select(
            F.lit("SYNTHETIC").alias("source_dataset"), F.col("store_id").alias("entity_id"),
            F.concat(F.lit("SYN_"), "sku_id").alias("product_key"), "date",
            F.col("units_sold").cast("double").alias("units_sold"), F.col("total_revenue").alias("revenue"), "_from", "_to",
        )
        online = star.online_sales(self.clean_lines).select(*keep[:4], F.col("units_sold").cast("double"), "revenue")
        return stored(syn.unionByName(online, allowMissingColumns=True), "panel")

    @cached_property
    def panel(self) -> DataFrame:
        """Dense synthetic weekly series and sparse online daily series, with splits.

        Only weeks with sales are written and dealt by series; zeros are filled in where a series then lies, so that
        windows over it need no further shuffle.
        """
        return self.panel_since()

    def panel_since(self, bound: str | None = None, rows: int = 0) -> DataFrame:
        """``panel``, without the weeks that lie more than ``rows`` weeks before ``bound`` (of ``features.split_bounds``).

        A dense series has a row in every week, so that many rows before any of the period are there; sparse series are whole.
        """
        observed, keep = self.observed, ["units_sold", "revenue"]
        dense = F.col("source_dataset") == "SYNTHETIC"
        weeks = F.sequence("_from", "_to", F.expr("interval 7 days"))
        size = self._panel_size
        at_hand = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = observed.repartition(max(1, min(at_hand, size // 1000), size // PANEL_ROWS), *features.GRAIN)
        day = F.col("date")
        ends = observed.select("source_dataset", F.explode(F.when(dense, F.array("_from", "_to")).otherwise(F.array(day))).alias("date"))
        filled = dealt.withColumn("_day", F.explode(F.when(dense, weeks).otherwise(F.array(day))))
        if bound is not None:
            first = features.split_bounds(ends).select("source_dataset", F.date_sub(bound, 7 * rows).alias("_first"))
            needed = ~dense | F.col("_day").isNull() | F.coalesce(F.col("_day") >= F.col("_first"), F.lit(True))
            filled = filled.join(F.broadcast(first), "source_dataset").where(needed).drop("_first")
        values = {c: F.when(dense & ~F.coalesce(F.col("_day") == day, F.lit(False)), 0.0).otherwise(F.col(c)) for c in keep}
        panel = filled.select(*features.GRAIN, F.col("_day").alias("date"), *[c.alias(n) for n, c in values.items()])
        return features.time_split(panel, ends)

    @cached_property
    def _panel_size(self) -> int:
        weeks = F.sequence("_from", "_to", F.expr("interval 7 days"))
        return self.observed.agg(F.sum(F.when(F.col("source_dataset") == "SYNTHETIC", F.size(weeks)).otherwise(1))).first()[0] or 0

    @cached_property
    def baseline_predictions(self) -> DataFrame:
        return baselines.attach_baselines(self.panel)

    @cached_property
    def forecast_rows(self) -> DataFrame:
        """Held-out forecasts at several horizons with bounds."""
        return self.forecasts_at(HORIZONS)

    def forecasts_at(self, horizons: Sequence[int]) -> DataFrame:
        """``forecast_rows`` of some horizons; they look no further back than the last step and the rows of its mean."""
        return baselines.horizon_forecasts(self.panel_since("test_start", max(horizons) + baselines.MEAN_ROWS - 1), horizons)

    @cached_property
    def backtest(self) -> DataFrame:
        return backtest.rolling_origin(self.weekly_demand)

    @cached_property
    def risk_matrix(self) -> DataFrame:
        return risk.risk_matrix(self.sales_daily, self.inventory_snapshots, self.sku_master, self.store_master)

    @cached_property
    def weekly_inventory(self) -> DataFrame:
        return star.weekly_inventory(self.inventory_snapshots)

    @cached_property
    def sku_risk(self) -> DataFrame:
        return risk.portfolio(self.sku_forecast, self.weekly_inventory, self.sku_master)

    @cached_property
    def sku_forecast(self) -> DataFrame:
        """Mean backtest forecast per synthetic SKU."""
        return (
            self.backtest.where(F.col("source_dataset") == "SYNTHETIC")
            .groupBy("product_key").agg(F.avg("candidate_forecast").alias("forecast_weekly_demand"))
        )
