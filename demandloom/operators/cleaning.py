"""Transaction-log cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.semantics import most_common
from demandloom.functions.vocabulary import CANCELLATION, INVALID, RETURN, SALE, UNKNOWN_PRODUCT


def transaction_type(invoice: str = "invoice", quantity: str = "quantity", price: str = "price") -> Column:
    """Prefix rules first; then a negative quantity outranks a negative price."""
    inv, qty, cost = F.col(invoice), F.col(quantity).try_cast("double"), F.col(price).try_cast("double")
    return (
        F.when(inv.startswith("C"), CANCELLATION)
        .when(inv.startswith("A"), INVALID)
        .when(qty < 0, RETURN)
        .when(cost < 0, INVALID)
        .otherwise(SALE)
    )


def recover_descriptions(lines: DataFrame) -> DataFrame:
    """Fill a missing description with the most common one of its stock code.

    The lookup is counted per (code, text) first; only lines without text meet
    it, so the join moves the gaps and not the log.
    """
    lines = lines.withColumn("description", F.nullif(F.trim("description"), F.lit("")))
    known = lines.where(F.col("description").isNotNull())
    lookup = most_common(known.select("stock_code", "description"), "stock_code", "description")
    lookup = lookup.withColumnRenamed("description", "_modal")
    gaps = lines.where(F.col("description").isNull()).join(lookup, "stock_code", "left")
    found = F.col("_modal").isNotNull()
    gaps = gaps.withColumns({
        "description": F.coalesce("_modal", F.lit(UNKNOWN_PRODUCT)),
        "description_recovered": found,
        "description_source": F.when(found, "recovered").otherwise("unknown"),
    }).drop("_modal")
    kept = known.withColumns({
        "description_recovered": F.lit(False),
        "description_source": F.when(F.col("description") == UNKNOWN_PRODUCT, "unknown").otherwise("original"),
    })
    return kept.unionByName(gaps)


def annotate(lines: DataFrame) -> DataFrame:
    """Type, calendar parts, guest flag and price category."""
    price = F.col("price").try_cast("double")
    at = F.try_to_timestamp(F.col("invoice_date").cast("string"))
    day = at.cast("date")
    return lines.withColumns({
        "transaction_type": transaction_type(),
        "invoice_date_only": day,
        "invoice_year": F.year(day),
        "invoice_month": F.month(day),
        "invoice_weekday": F.weekday(day),
        "is_guest_transaction": F.col("customer_id").isNull(),
        "price_category": F.when(price < 0, "PRICE_NEGATIVE").when(price == 0, "PRICE_ZERO")
        .when(price > 0, "PRICE_POSITIVE").otherwise("PRICE_INVALID"),
        "is_special_transaction": F.coalesce(price <= 0, F.lit(False)),
    })


def clean_transactions(log: DataFrame) -> DataFrame:
    """Recovered, annotated and exactly de-duplicated lines."""
    # annotations follow from the raw columns, so the narrow rows are compared
    return annotate(recover_descriptions(log).dropDuplicates())


def split(lines: DataFrame, kind: str) -> DataFrame:
    return lines.where(F.col("transaction_type") == kind)


def sale_lines(log: DataFrame) -> DataFrame:
    """Weekly-ingest rule: real, positive, dated sales without exact copies."""
    return log.where(
        ~F.col("invoice").startswith("C") & (F.col("quantity") > 0) & (F.col("price") > 0) & F.col("invoice_date").isNotNull()
    ).dropDuplicates()


def inventory_balance(snapshots: DataFrame) -> DataFrame:
    """Opening stock already holds the day's receipts; derive the stock before them."""
    before = F.col("beginning_inventory") - F.col("receipts")
    return snapshots.withColumns({
        "beginning_inventory_pre_receipts": before,
        "inventory_balance_ok": before + F.col("receipts") - F.col("units_sold") == F.col("ending_inventory"),
    })
