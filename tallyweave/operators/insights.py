"""Expiry windows, unmatched items, price anomalies and the reminders they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.dates import days_until, is_overdue, within_days
from tallyweave.functions.numbers import relative_deviation
from tallyweave.functions.text import strip
from tallyweave.operators.contains import contains_pairs
from tallyweave.operators.history import STATS_KEYS

INSIGHT_COLUMNS = [
    "category", "severity", "title", "message", "suggested_due_date", "linked_entity_type",
    "linked_entity_id",
]


def expiring(documents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    expiry = F.col("expiry_date")
    return documents.filter(within_days(expiry, as_of, days)).withColumn(
        "days_left", days_until(expiry, as_of)
    )


def upcoming(reminders: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Open reminders due up to `days` ahead, the overdue ones included."""
    return reminders.filter(
        ~F.col("is_done") & (F.col("due_date") <= F.date_add(as_of, days))
    ).withColumn("is_overdue", is_overdue(F.col("due_date"), F.col("is_done"), as_of))


def by_linked_entity(reminders: DataFrame, entities: DataFrame) -> DataFrame:
    """Reminders of a set of (linked_entity_type, linked_entity_id)."""
    keys = ["linked_entity_type", "linked_entity_id"]
    return reminders.join(entities.select(*keys).distinct(), keys, "left_semi")


def expiry_insights(documents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    left = F.col("days_left")
    return expiring(documents, as_of, days).select(
        F.lit("expiring_document").alias("category"),
        F.when(left <= 7, "critical").otherwise("warning").alias("severity"),
        F.concat(F.lit("Expiring: "), "title").alias("title"),
        F.format_string("%s expires on %s (%d days remaining)", "title",
                        F.col("expiry_date").cast("string"), left).alias("message"),
        F.col("expiry_date").alias("suggested_due_date"),
        F.lit("company_document").alias("linked_entity_type"),
        F.col("id").cast("string").alias("linked_entity_id"),
    )


def first_per_name(items: DataFrame) -> DataFrame:
    """One row per lower-case name: the one with the highest id."""
    named = items.withColumn("_name", F.lower(strip(F.col("item_name")))).filter("_name <> ''")
    row = F.struct(*[F.col(c) for c in items.columns])
    picked = named.groupBy("_name").agg(F.max_by(row, F.col("id")).alias("_row"))
    return picked.select(F.col("_name").alias("normalized_name"), "_row.*")


def unmatched_insights(unmatched: DataFrame) -> DataFrame:
    name = strip(F.col("item_name"))
    # The optimizer prunes no field of the row picked per name, so only what is told goes in.
    return first_per_name(unmatched.select("id", "item_name")).select(
        F.lit("unmatched_item").alias("category"),
        F.lit("info").alias("severity"),
        F.concat(F.lit("Unmatched item: "), name).alias("title"),
        F.concat(F.lit("Item '"), name, F.lit("' has no matched material in the catalog")).alias(
            "message"
        ),
        F.lit(None).cast("date").alias("suggested_due_date"),
        F.lit("invoice_item").alias("linked_entity_type"),
        F.col("id").cast("string").alias("linked_entity_id"),
    )


def item_anomalies(
    items: DataFrame, stats: DataFrame, threshold: float = 0.20, match: str = "exact"
) -> DataFrame:
    """Items far from the item's most frequent statistics row, sellers ignored."""
    named = items.withColumn("_name", F.lower(strip(F.col("item_name")))).filter(
        (F.col("_name") != "") & (F.col("unit_price") > 0)
    )
    order = F.struct(-F.col("occurrence_count"), *[F.col(k) for k in STATS_KEYS])
    best = F.min_by(F.struct("occurrence_count", "avg_price"), order).alias("stat")
    if match == "contains":
        pairs = contains_pairs(
            named.select(F.col("_name").alias("needle")),
            stats.select(F.col("item_name_normalized").alias("haystack")),
        )
        candidates = pairs.select(
            F.col("needle").alias("_name"), F.col("haystack").alias("item_name_normalized")
        ).join(stats, "item_name_normalized")
    else:
        candidates = stats.withColumn("_name", F.col("item_name_normalized"))
    reference = candidates.groupBy("_name").agg(best)
    return (
        named.join(reference, "_name")
        .filter((F.col("stat.occurrence_count") >= 2) & (F.col("stat.avg_price") > 0))
        .withColumn("deviation", relative_deviation(F.col("unit_price"), F.col("stat.avg_price")))
        .filter(F.col("deviation") > threshold)
        .select("id", "item_name", "unit_price", "deviation", "stat.*")
    )


def _figure(value: Column) -> Column:
    """Six digits. The last bits of a mean hang on the order of its sum, so they go first."""
    return F.round(F.round(value, 9), 6)


def anomaly_insights(
    items: DataFrame, stats: DataFrame, threshold: float = 0.20, match: str = "exact"
) -> DataFrame:
    return item_anomalies(items, stats, threshold, match).select(
        F.lit("price_anomaly").alias("category"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("Price anomaly: "), "item_name").alias("title"),
        F.format_string("'%s' priced at %s deviates %s%% from average %s", "item_name",
                        _figure(F.col("unit_price")), F.round(_figure(F.col("deviation") * 100), 1),
                        _figure(F.col("avg_price"))).alias("message"),
        F.lit(None).cast("date").alias("suggested_due_date"),
        F.lit("invoice_item").alias("linked_entity_type"),
        F.col("id").cast("string").alias("linked_entity_id"),
    )


def all_insights(
    documents: DataFrame,
    unmatched: DataFrame,
    items: DataFrame,
    stats: DataFrame,
    as_of: Column,
    days: int = 30,
) -> DataFrame:
    return (
        expiry_insights(documents, as_of, days)
        .unionByName(unmatched_insights(unmatched))
        .unionByName(anomaly_insights(items, stats))
    )


def insight_counts(insights: DataFrame) -> DataFrame:
    return insights.groupBy("category").agg(F.count(F.lit(1)).alias("insights"))


def new_reminders(insights: DataFrame, reminders: DataFrame, as_of: Column) -> DataFrame:
    """Reminders to create: insights without an open reminder on the same entity."""
    keys = ["linked_entity_type", "linked_entity_id"]
    active = reminders.filter(~F.col("is_done")).select(
        "linked_entity_type", F.col("linked_entity_id").cast("string").alias("linked_entity_id")
    )
    return insights.join(active.distinct(), keys, "left_anti").select(
        "title",
        "message",
        F.coalesce("suggested_due_date", F.date_add(as_of, 7)).alias("due_date"),
        *keys,
    )
