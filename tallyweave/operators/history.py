"""Price history and price statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import normalized_name

STATS_KEYS = ["item_name_normalized", "hs_code", "seller_name", "currency"]


def price_history(lines: DataFrame, invoices: DataFrame, as_of: Column) -> DataFrame:
    """One history row per priced line item; undated invoices count as of today."""
    priced = lines.filter((F.col("row_type") == "line_item") & (F.col("unit_price") > 0))
    header = invoices.select(
        F.col("id").alias("invoice_id"),
        F.coalesce("invoice_date", as_of).alias("invoice_date"),
        "currency",
    )
    return priced.join(header, "invoice_id").select(
        normalized_name(F.col("item_name")).alias("item_name_normalized"),
        "hs_code",
        "seller_name",
        "invoice_id",
        "invoice_date",
        "quantity",
        "unit_price",
        "currency",
    )


def price_trend(low: Column, high: Column, mean: Column) -> Column:
    spread = F.try_divide(high - low, mean)
    return (
        F.when(low == high, "stable")
        .when(spread < 0.05, "stable")
        .when(spread < 0.20, "moderate")
        .otherwise("volatile")
    )


def price_stats(history: DataFrame) -> DataFrame:
    """Count, range and trend per item, code, seller and currency."""
    grouped = history.groupBy(*STATS_KEYS).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("unit_price").alias("min_price"),
        F.max("unit_price").alias("max_price"),
        F.avg("unit_price").alias("avg_price"),
        F.min("invoice_date").alias("first_seen"),
        F.max("invoice_date").alias("last_seen"),
    )
    return grouped.withColumn(
        "price_trend", price_trend(F.col("min_price"), F.col("max_price"), F.col("avg_price"))
    )


def contains_text(c: Column, needle: str) -> Column:
    """Case-blind substring test."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_history(
    history: DataFrame,
    item_name: str | None = None,
    seller: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    conditions: list[Column] = []
    if item_name:
        conditions.append(contains_text(F.col("item_name_normalized"), item_name))
    if seller:
        conditions.append(contains_text(F.col("seller_name"), seller))
    if date_from:
        conditions.append(F.col("invoice_date") >= F.lit(date_from).cast("date"))
    if date_to:
        conditions.append(F.col("invoice_date") <= F.lit(date_to).cast("date"))
    return history.filter(_all(conditions)).withColumnRenamed("item_name_normalized", "item_name")


def filter_stats(
    history: DataFrame, item_name: str | None = None, seller: str | None = None
) -> DataFrame:
    """Statistics of some items or sellers; the filter works before the grouping."""
    conditions: list[Column] = []
    if item_name:
        conditions.append(contains_text(F.col("item_name_normalized"), item_name))
    if seller:
        conditions.append(contains_text(F.col("seller_name"), seller))
    return price_stats(history.filter(_all(conditions)))


def link_material(history: DataFrame, links: DataFrame) -> DataFrame:
    """Set the material on every row whose name is linked.

    `links` has (item_name_normalized, material_id); the smallest id wins a tie.
    """
    unique = links.groupBy("item_name_normalized").agg(F.min("material_id").alias("_linked"))
    kept = F.col("material_id") if "material_id" in history.columns else F.lit(None)
    return (
        history.join(unique, "item_name_normalized", "left")
        .withColumn("material_id", F.coalesce("_linked", kept.cast("string")))
        .drop("_linked")
    )
