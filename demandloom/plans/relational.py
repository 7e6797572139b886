"""Primitive scans, joins, aggregates and windows on the source tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.functions.quantiles import exact_quantiles
from demandloom.functions.semantics import most_common, rnd
from demandloom.operators import backtest, baselines, bi, features, metrics, risk, star
from demandloom.plans.registry import query
from demandloom.plans.sqltext import ci, pct, r
from demandloom.sources import files

@query("a1_csv_scan", f"SELECT c_nationkey AS nation_key, count(*) AS customers, {r('sum(c_acctbal)', 2)} AS balance FROM customer GROUP BY 1")
def a1(t):
    """Written with untidy headers, read with an explicit schema and snake_case names."""
    path = files.scratch(t.spark, "customer-csv")
    t.table("customer").toDF(" CustKey ", "Name", " Nation Key", "Acct Bal ", "Segment").write.option("header", True).csv(path)
    schema = "`Cust Key` bigint, Name string, ` Nation Key` int, `Acct Bal ` double, Segment string"
    df = files.read_csv(t.spark, path, schema)
    return df.groupBy("nation_key").agg(F.count("*").alias("customers"), rnd(F.sum("acct_bal"), 2).alias("balance"))


@query("a2_parquet_scan", "SELECT count(*) AS rows, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def a2(t):
    return t.table("lineitem").agg(F.count("*").alias("rows"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("a3_projection_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01 00:00:00' AND l_quantity > 40")
def a3(t):
    return t.table("lineitem").where("l_shipdate >= timestamp_ntz '2001-06-01 00:00:00' AND l_quantity > 40").select("l_orderkey", "l_quantity")


@query("a4_fallback_source", "SELECT count(*) AS rows FROM supplier")
def a4(t):
    df = files.resolve(t.spark, ("parquet", f"{t.folder}/supplier_clean.parquet"), ("parquet", f"{t.folder}/supplier.parquet"), ("csv", f"{t.folder}/supplier.csv"))
    return df.agg(F.count("*").alias("rows"))


@query("a5_reused_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a5(t):
    """Loaded once per run: the property returns the same plan to every user."""
    assert t.sales_daily is t.sales_daily
    t.table("orders").createOrReplaceTempView("orders_loaded")
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM orders_loaded GROUP BY 1")


@query("a6_csv_statistics", f"SELECT l_returnflag, count(*) AS rows, {r('sum(l_quantity)', 2)} AS quantity, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1")
def a6(t):
    path = files.scratch(t.spark, "lineitem-csv")
    t.table("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice").write.option("header", True).csv(path)
    df = files.read_csv(t.spark, path, "l_returnflag string, l_quantity double, l_extendedprice double")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("rows"), rnd(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))


@query("a7_json_roundtrip", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def a7(t):
    path = files.scratch(t.spark, "events-json")
    parsed = t.table("events").select("event_id", "event_type", F.from_json("props", "k int").alias("props"))
    files.write_json(parsed, path)
    return files.read_json(t.spark, path, parsed.schema).select("event_id", "event_type", "props.k")


@query("a8_split_sink", "SELECT transaction_type, count(*) AS lines, sum(quantity) AS quantity FROM clean_lines GROUP BY 1")
def a8(t):
    path = files.scratch(t.spark, "lines-split")
    files.write_split(t.clean_lines.select("transaction_type", "invoice", "quantity"), path, "transaction_type")
    back = t.spark.read.schema("invoice string, quantity double, transaction_type string").parquet(path)
    return back.groupBy("transaction_type").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


@query("a9_snapshot_history", "SELECT s.snapshot_ts, o_orderstatus, count(*) AS n FROM orders, (VALUES ('2024-01-01'), ('2024-01-02')) s(snapshot_ts) GROUP BY 1, 2")
def a9(t):
    path = files.scratch(t.spark, "history")
    for stamp in ("2024-01-01", "2024-01-02"):
        files.append_snapshot(t.table("orders").select("o_orderkey", "o_orderstatus"), path, stamp)
    back = t.spark.read.schema("o_orderkey bigint, o_orderstatus string, snapshot_ts string").parquet(path)
    return back.groupBy("snapshot_ts", "o_orderstatus").agg(F.count("*").alias("n"))


@query("a10_batch_job", f"SELECT product_key, count(*) AS n, {r('sum(CASE WHEN pos > 1 THEN before END)', 4)} AS forecast FROM (SELECT *, row_number() OVER w AS pos, lag(units_sold) OVER w AS before FROM weekly_sku WINDOW w AS (PARTITION BY product_key ORDER BY week)) t GROUP BY 1")
def a10(t):
    source, target = files.scratch(t.spark, "batch-in"), files.scratch(t.spark, "batch-out")
    star.weekly_sku(t.sales_daily).select("product_key", "week", "units_sold").write.parquet(source)
    out = files.run_batch(t.spark, source, target, lambda d: d.withColumn("prediction", F.lag("units_sold").over(features.series(["product_key"], "week"))))
    return out.groupBy("product_key").agg(F.count("*").alias("n"), rnd(F.sum("prediction"), 4).alias("forecast"))


@query("a11_file_manifest")
def a11(t):
    return files.manifest(t.spark, t.folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size", "lines", "content")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("a11_table_inventory", " UNION ALL ".join(f"SELECT '{n}.parquet' AS dataset, count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM {n}) d) AS INTEGER) AS columns FROM {n}" for n in TABLES))
def a11_inventory(t):
    found = files.inventory(t.spark, t.folder).where("format = 'parquet'")
    return found.groupBy("dataset").agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"))


@query("a12_rename", "SELECT n_nationkey AS nation_id, n_name AS nation FROM nation")
def a12(t):
    return t.table("nation").withColumnsRenamed({"n_nationkey": "nation_id", "n_name": "nation"}).select("nation_id", "nation")


@query("a13_conditional", "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, l_discount > 0.05 AS discounted, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a13(t):
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return t.table("lineitem").groupBy(size.alias("size"), (F.col("l_discount") > 0.05).alias("discounted")).agg(F.count("*").alias("n"))


@query("a14_membership", f"""
SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, {ci('o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)')} AS rich, {ci('o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)')} AS other FROM orders GROUP BY 1""")
def a14(t):
    rich = t.table("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent")
    count = lambda how, name: t.table("orders").join(rich, "o_custkey", how).groupBy(urgent).agg(F.count("*").alias(name))
    return count("left_semi", "rich").join(count("left_anti", "other"), "urgent", "full")


@query("a15_multi_filter", "SELECT product_key, forecast_date, horizon FROM forecast_rows WHERE source_dataset = 'SYNTHETIC' AND entity_id = 'STORE_1' AND forecast_date >= DATE '2001-03-01' AND forecast_date <= DATE '2001-08-31' AND horizon = 3")
def a15(t):
    kept = bi.select_rows(t.forecast_rows, dataset="SYNTHETIC", entity="STORE_1", start="2001-03-01", end="2001-08-31", horizon=3, risk_level="LOW / SAFE")
    return kept.select("product_key", "forecast_date", "horizon")


@query("a16_top_entities", """
SELECT s.date, s.store_id, s.sku_id, s.units_sold FROM sales_daily s WHERE date >= DATE '2001-01-01' AND store_id IN (SELECT store_id FROM (SELECT store_id, sum(units_sold) AS u FROM sales_daily GROUP BY 1 ORDER BY u DESC, store_id LIMIT 3) k)""")
def a16(t):
    top = t.daily_units.groupBy("store_id").agg(F.sum("units_sold").alias("u")).orderBy(F.desc("u"), "store_id").limit(3)
    return t.daily_units.where("date >= date '2001-01-01'").join(top, "store_id", "left_semi").select("date", "store_id", "sku_id", "units_sold")


@query("a17_finite_mask", f"SELECT source_dataset, count(*) AS rows, {ci('naive IS NOT NULL AND units_sold IS NOT NULL')} AS usable FROM baseline_predictions GROUP BY 1")
def a17(t):
    usable = metrics.finite(t.baseline_predictions, "naive", "units_sold").groupBy("source_dataset").agg(F.count("*").alias("usable"))
    return t.panel.groupBy("source_dataset").agg(F.count("*").alias("rows")).join(usable, "source_dataset", "left")


@query("a18_inner_join", "SELECT o_orderstatus, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def a18(t):
    j = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("a19_dimension_join", "SELECT n_name, r_name, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def a19(t):
    c, n, g = t.table("customer"), t.table("nation"), t.table("region")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(g, n.n_regionkey == g.r_regionkey, "left")
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("a20_full_outer_join", "SELECT COALESCE(a.k, b.k) AS k, n_ship, n_order FROM (SELECT CAST(l_shipdate AS DATE) AS k, count(*) AS n_ship FROM lineitem GROUP BY 1) a FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS k, count(*) AS n_order FROM orders GROUP BY 1) b ON a.k = b.k")
def a20(t):
    a = t.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("k")).agg(F.count("*").alias("n_ship"))
    return a.join(t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("k")).agg(F.count("*").alias("n_order")), "k", "full")


@query("a21_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def a21(t):
    c, o = t.table("customer"), t.table("orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("a22_latest_snapshot_join", "SELECT k.sku_id, count(store_id) AS stores, CAST(sum(ending_inventory) AS BIGINT) AS stock FROM sku_master k LEFT JOIN (SELECT * FROM inventory_snapshots WHERE date = (SELECT max(date) FROM inventory_snapshots)) i ON k.sku_id = i.sku_id GROUP BY 1")
def a22(t):
    j = t.sku_master.join(risk.latest(t.inventory_snapshots, "date"), "sku_id", "left")
    return j.groupBy("sku_id").agg(F.count("store_id").alias("stores"), F.sum("ending_inventory").alias("stock"))


@query("a23_dedup_then_join", "SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_brand) AS p_brand FROM part GROUP BY 1) p ON l_partkey = p_partkey GROUP BY 1, 2")
def a23(t):
    p = t.table("part")
    dims = features.unique_by(p.unionByName(p), ["p_partkey"], ["p_brand"])
    j = t.table("lineitem").join(dims, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))


@query("a24_fold_expansion", "SELECT fold, source_dataset, count(*) AS rows FROM (SELECT fold, d.source_dataset FROM weekly_demand d JOIN fold_origins o ON d.source_dataset = o.source_dataset AND d.week <= o.origin) t GROUP BY 1, 2")
def a24(t):
    """Rows x folds from counts per week: the expansion never materialises."""
    weeks = t.weekly_demand.groupBy("source_dataset", "week").agg(F.count("*").alias("n"))
    origins = backtest.fold_weeks(t.weekly_demand).groupBy("source_dataset", "fold").agg(F.max("origin").alias("origin"))
    return weeks.join(F.broadcast(origins), "source_dataset").where("week <= origin").groupBy("fold", "source_dataset").agg(F.sum("n").alias("rows"))


@query("a25_aggregates", f"""
SELECT l_returnflag, sum(l_quantity) AS total, {r('avg(l_quantity)', 6)} AS mean, min(l_quantity) AS lowest, max(l_quantity) AS highest, count(*) AS n, {r('stddev_samp(l_quantity)', 6)} AS std, quantile_cont(l_quantity, 0.5) AS median, arg_min(l_extendedprice, (l_shipdate, l_extendedprice)) AS first_price,
 arg_max(l_extendedprice, (l_shipdate, l_extendedprice)) AS last_price FROM lineitem GROUP BY 1""")
def a25(t):
    q, p = F.col("l_quantity"), F.struct("l_shipdate", "l_extendedprice")
    table = t.table("lineitem").groupBy("l_returnflag").agg(
        F.sum(q).alias("total"), rnd(F.avg(q), 6).alias("mean"), F.min(q).alias("lowest"), F.max(q).alias("highest"), F.count("*").alias("n"), rnd(F.stddev_samp(q), 6).alias("std"),
        F.min_by("l_extendedprice", p).alias("first_price"), F.max_by("l_extendedprice", p).alias("last_price"))
    return table.join(exact_quantiles(t.table("lineitem"), "l_quantity", [0.5], ["l_returnflag"], ["median"]).drop("n"), "l_returnflag")


@query("a26_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def a26(t):
    return t.table("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("a27_conditional_counts", f"SELECT {ci('c_acctbal < 0')} AS negative, {ci('c_acctbal = 0')} AS zero, {ci('c_acctbal > 0')} AS positive FROM customer")
def a27(t):
    b = F.col("c_acctbal")
    return t.table("customer").agg(F.count_if(b < 0).alias("negative"), F.count_if(b == 0).alias("zero"), F.count_if(b > 0).alias("positive"))


@query("a28_value_counts", f"SELECT event_type, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM events)')} AS share_pct FROM events GROUP BY 1")
def a28(t):
    e = t.table("events")
    whole = e.agg(F.count("*").alias("n")).select("n").scalar()
    return e.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share_pct", rnd(F.col("n") / whole * 100.0, 4))


@query("a29_absolute_sum", "SELECT stock_code, sum(abs(quantity)) AS moved FROM retail_log GROUP BY 1")
def a29(t):
    return t.retail_log.groupBy("stock_code").agg(F.sum(F.abs("quantity")).alias("moved"))


@query("a30_quantiles", f"SELECT l_linestatus, {', '.join(f'{r(f'quantile_cont(l_extendedprice, {p})', 6)} AS {n}' for p, n in ((0.01, 'p01'), (0.25, 'p25'), (0.5, 'p50'), (0.9, 'p90'), (0.99, 'p99')))}, count(*) AS n FROM lineitem GROUP BY 1")
def a30(t):
    names = ["p01", "p25", "p50", "p90", "p99"]
    q = exact_quantiles(t.table("lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.9, 0.99], ["l_linestatus"], names)
    return q.withColumns({c: rnd(c, 6) for c in names})


@query("a31_correlation", f"SELECT l_returnflag, {r('corr(l_quantity, l_extendedprice)', 6)} AS quantity_price, {r('corr(l_quantity, l_discount)', 6)} AS quantity_discount, {r('corr(l_extendedprice, l_tax)', 6)} AS price_tax FROM lineitem GROUP BY 1")
def a31(t):
    pair = lambda a, b: rnd(F.corr(a, b), 6)
    return t.table("lineitem").groupBy("l_returnflag").agg(
        pair("l_quantity", "l_extendedprice").alias("quantity_price"), pair("l_quantity", "l_discount").alias("quantity_discount"), pair("l_extendedprice", "l_tax").alias("price_tax"))


@query("a32_pivot", f"SELECT l_linenumber, {', '.join(f'{r(f"COALESCE(avg(CASE WHEN l_returnflag = {chr(39)}{f}{chr(39)} THEN l_quantity END), 0)", 6)} AS {f}' for f in 'ANR')} FROM lineitem GROUP BY 1")
def a32(t):
    p = t.table("lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity")).na.fill(0.0)
    return p.withColumns({c: rnd(c, 6) for c in "ANR"})


@query("a33_mode", "SELECT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS k FROM lineitem GROUP BY 1, 2) t WHERE k = 1")
def a33(t):
    return most_common(t.table("lineitem"), "l_suppkey", "l_linenumber")


@query("a34_label_list", "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def a34(t):
    return t.table("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("nations"))


EDGES = (0, 1000, 5000, 20000, 50000, 80000, 200000)


@query("a35_histogram", f"SELECT b AS bin, count(*) AS n FROM (SELECT {' + '.join(f'CASE WHEN l_extendedprice >= {e} THEN 1 ELSE 0 END' for e in EDGES[:-1])} AS b FROM lineitem WHERE l_extendedprice BETWEEN {EDGES[0]} AND {EDGES[-1]}) t GROUP BY 1")
def a35(t):
    p = F.col("l_extendedprice")
    bin_no = sum(((p >= e).cast("int") for e in EDGES[1:-1]), (p >= EDGES[0]).cast("int"))
    return t.table("lineitem").where(p.between(EDGES[0], EDGES[-1])).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))


@query("a36_equal_frequency_bins", f"""
SELECT f.l_linestatus, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < l_quantity)) AS INTEGER) AS bin, count(*) AS n, {r('avg(l_extendedprice)', 4)} AS mean_price FROM lineitem f
JOIN (SELECT l_linestatus, list_sort(list_distinct([{', '.join(f'quantile_cont(l_quantity, {i / 5})' for i in range(6))}])) AS e FROM lineitem GROUP BY 1) c ON f.l_linestatus = c.l_linestatus GROUP BY 1, 2""")
def a36(t):
    binned = metrics.bin_by_quantile(t.table("lineitem").select("l_linestatus", "l_quantity", "l_extendedprice"), ["l_quantity"], 5, ["l_linestatus"])
    return binned.groupBy("l_linestatus", F.col("l_quantity_bin").alias("bin")).agg(F.count("*").alias("n"), rnd(F.avg("l_extendedprice"), 4).alias("mean_price"))


PW = "PARTITION BY source_dataset, product_key ORDER BY week"
W = ["source_dataset", "product_key", "week"]


def _win(t):
    return t.weekly_demand.select(*W, "units_sold"), features.series(["source_dataset", "product_key"], "week")


@query("a37_a38_shift", f"SELECT source_dataset, product_key, week, lag(units_sold, 2) OVER w AS two_back, lead(units_sold, 3) OVER w AS three_ahead FROM weekly_demand WINDOW w AS ({PW})")
def a37(t):
    d, w = _win(t)
    return d.select(*W, F.lag("units_sold", 2).over(w).alias("two_back"), F.lead("units_sold", 3).over(w).alias("three_ahead"))


@query("a39_a40_trailing_frames", f"""
SELECT source_dataset, product_key, week, {r(f'avg(units_sold) OVER ({PW} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)', 6)} AS before_4, min(units_sold) OVER ({PW} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS low_4,
 {r(f'avg(units_sold) OVER ({PW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 6)} AS with_current_4 FROM weekly_demand""")
def a39(t):
    d, w = _win(t)
    return d.select(*W, rnd(F.avg("units_sold").over(features.trailing(w, 4)), 6).alias("before_4"), F.min("units_sold").over(features.trailing(w, 4)).alias("low_4"),
                    rnd(F.avg("units_sold").over(w.rowsBetween(-3, 0)), 6).alias("with_current_4"))


@query("a41_a42_full_and_expanding", f"""
SELECT source_dataset, product_key, week, {r(f'CASE WHEN count(*) OVER ({PW} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 6 THEN avg(units_sold) OVER ({PW} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END', 6)} AS full_mean_6,
 {r(f'avg(units_sold) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 6)} AS expanding FROM weekly_demand""")
def a41(t):
    d, _ = _win(t)
    full = features.full_rolling(["source_dataset", "product_key"], "units_sold", [6], "week", ["mean"], "full_{stat}_{w}")["full_mean_6"]
    return d.select(*W, rnd(full, 6).alias("full_mean_6"), rnd(baselines.historical_mean(features.series(["source_dataset", "product_key"], "week")), 6).alias("expanding"))


@query("a44_cumulative_share", f"""
SELECT source_dataset, product_key, week, {r(f'sum(units_sold) OVER ({PW}) / CAST(sum(units_sold) OVER (PARTITION BY source_dataset, product_key) AS DOUBLE)', 6)} AS share FROM weekly_demand""")
def a44(t):
    d, w = _win(t)
    whole = Window.partitionBy("source_dataset", "product_key")
    return d.select(*W, rnd(F.sum("units_sold").over(w) / F.sum("units_sold").over(whole), 6).alias("share"))


@query("a45_ranks", f"""
SELECT source_dataset, product_key, week, rank() OVER x AS min_rank, row_number() OVER (PARTITION BY source_dataset, product_key ORDER BY units_sold DESC, week) AS row_rank, {r('rank() OVER x / CAST(count(*) OVER (PARTITION BY source_dataset, product_key) AS DOUBLE)', 6)} AS rank_pct
FROM weekly_demand WINDOW x AS (PARTITION BY source_dataset, product_key ORDER BY units_sold DESC)""")
def a45(t):
    d, _ = _win(t)
    g = Window.partitionBy("source_dataset", "product_key")
    return d.select(*W, F.rank().over(g.orderBy(F.desc("units_sold"))).alias("min_rank"), F.row_number().over(g.orderBy(F.desc("units_sold"), "week")).alias("row_rank"),
                    rnd(F.rank().over(g.orderBy(F.desc("units_sold"))) / F.count("*").over(g), 6).alias("rank_pct"))


@query("a46_nth_row", f"SELECT source_dataset, product_key, week, units_sold FROM (SELECT *, row_number() OVER ({PW}) AS k FROM weekly_demand) t WHERE k = 3")
def a46(t):
    d, w = _win(t)
    return d.withColumn("k", F.row_number().over(w)).where("k = 3").drop("k")


@query("a47_group_median_back", f"SELECT d.source_dataset, d.product_key, week, units_sold - m AS above_median FROM weekly_demand d JOIN (SELECT source_dataset, product_key, quantile_cont(CAST(units_sold AS DOUBLE), 0.5) AS m FROM weekly_demand GROUP BY 1, 2) q ON d.source_dataset = q.source_dataset AND d.product_key = q.product_key")
def a47(t):
    d, _ = _win(t)
    g = Window.partitionBy("source_dataset", "product_key")  # bounded by the calendar
    return d.select(*W, (F.col("units_sold") - F.percentile("units_sold", F.lit(0.5)).over(g)).alias("above_median"))


@query("a48_date_difference", f"SELECT source_dataset, product_key, week, week - lag(week) OVER ({PW}) AS days_since FROM weekly_demand")
def a48(t):
    d, w = _win(t)
    return d.select(*W, F.date_diff("week", F.lag("week").over(w)).alias("days_since"))


@query("sort_limit_top", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def top(t):
    return t.table("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("set_union_padded", "SELECT kind, count(*) AS rows, count(balance) AS with_balance, count(size) AS with_size FROM (SELECT 'supplier' AS kind, s_acctbal AS balance, NULL AS size FROM supplier UNION ALL SELECT 'part', NULL, p_size FROM part) u GROUP BY 1")
def padded(t):
    s = t.table("supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    u = s.unionByName(t.table("part").select(F.lit("part").alias("kind"), F.col("p_size").alias("size")), allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("rows"), F.count("balance").alias("with_balance"), F.count("size").alias("with_size"))


@query("set_difference", "SELECT l_suppkey AS supplier, l_partkey AS part FROM lineitem EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def difference(t):
    pairs = t.table("lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
    return pairs.subtract(t.table("lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey"))


@query("set_intersection", "SELECT l_suppkey AS supplier, l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def intersection(t):
    pick = lambda f: t.table("lineitem").where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
    return pick("A").intersect(pick("N"))


@query("scalar_strings", """
SELECT p_partkey, lower(trim(concat(' ', p_name, ' '))) AS name, replace(p_brand, 'Brand#', '') AS brand, substr(p_type, 1, 3) AS kind, starts_with(p_name, 's') AS s_name, regexp_replace(p_name, '^[a-z]+ ', '') AS noun FROM part""")
def strings(t):
    return t.table("part").select(
        "p_partkey", F.lower(F.trim(F.concat(F.lit(" "), "p_name", F.lit(" ")))).alias("name"), F.regexp_replace("p_brand", "Brand#", "").alias("brand"), F.substring("p_type", 1, 3).alias("kind"),
        F.col("p_name").startswith("s").alias("s_name"), F.regexp_replace("p_name", "^[a-z]+ ", "").alias("noun"))


@query("scalar_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, monthname(o_orderdate) AS month_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
 CAST(o_orderdate AS DATE) + 28 AS later, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""")
def dates(t):
    d = F.col("o_orderdate").cast("date")
    return t.table("orders").select(
        "o_orderkey", F.date_format(d, "yyyy-MM").alias("period"), F.date_format(d, "MMMM").alias("month_name"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"),
        F.dayofyear(d).alias("doy"), F.date_add(d, 28).alias("later"), F.date_diff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"))


@query("scalar_math_and_casts", f"""
SELECT c_custkey, {r('sqrt(abs(c_acctbal))', 6)} AS root, {r('ln(greatest(c_acctbal, 1))', 6)} AS log, CAST(ceil(c_acctbal / 7) AS BIGINT) AS weeks, {r('least(greatest(c_acctbal, 0), 5000)', 2)} AS clipped, round_even(c_acctbal, 0) AS rounded, TRY_CAST(c_mktsegment AS DOUBLE) AS coerced FROM customer""")
def math_(t):
    b = F.col("c_acctbal")
    return t.table("customer").select(
        "c_custkey", rnd(F.sqrt(F.abs(b)), 6).alias("root"), rnd(F.log(F.greatest(b, F.lit(1.0))), 6).alias("log"), F.ceil(b / 7).alias("weeks"), rnd(F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)), 2).alias("clipped"),
        (F.rint(b) + 0.0).alias("rounded"), F.col("c_mktsegment").try_cast("double").alias("coerced"))
