"""Roll-ups over invoices and lines, quality scores and dashboard figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.numbers import clamp01


def _line_item(value: Column) -> Column:
    return F.when(F.col("row_type") == "line_item", value)


def invoice_totals(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Item count, line sum and quantity (line items only) and the 1 % mismatch flag."""
    sums = lines.groupBy("invoice_id").agg(
        F.count(_line_item(F.lit(1))).alias("items_count"),
        F.sum(_line_item(F.col("total_price"))).alias("calculated_total"),
        F.sum(_line_item(F.col("quantity"))).alias("total_quantity"),
    )
    joined = invoices.select(F.col("id").alias("invoice_id"), "total_amount").join(
        sums, "invoice_id", "left"
    )
    zero = F.lit(0.0)
    calculated = F.coalesce("calculated_total", zero)
    total = F.col("total_amount")
    return joined.select(
        "invoice_id",
        "total_amount",
        F.coalesce("items_count", F.lit(0)).alias("items_count"),
        calculated.alias("calculated_total"),
        F.coalesce("total_quantity", zero).alias("total_quantity"),
        ((total != 0.0) & (F.abs(total - calculated) > total * 0.01)).alias("has_total_mismatch"),
    )


def document_totals(
    lines: DataFrame, tax_rate: float, discount: float = 0.0, digits: int | None = 2
) -> DataFrame:
    """Subtotal, tax and total of a document to be issued."""

    def cut(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    sums = lines.groupBy("document_id").agg(
        cut(F.sum(F.col("quantity") * F.col("unit_price"))).alias("subtotal")
    )
    with_tax = sums.withColumn("tax_amount", cut(F.col("subtotal") * tax_rate / 100))
    return with_tax.withColumn(
        "total", cut(F.col("subtotal") + F.col("tax_amount") - F.lit(discount))
    )


def _coverage(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def _line_coverage(lines: DataFrame) -> DataFrame:
    qty, price, total = F.col("quantity"), F.col("unit_price"), F.col("total_price")
    return lines.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("_n"),
        _coverage(qty > 0).alias("_qty"),
        _coverage(price > 0).alias("_price"),
        _coverage((price > 0) | (total > 0)).alias("_any_price"),
        _coverage(F.coalesce(F.col("hs_code"), F.lit("")) != "").alias("_hs"),
        F.bool_and(F.abs(total - qty * price) <= 0.01).alias("_math"),
    )


def _present(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") != "", F.lit(False))


def _points(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def _ratio(c: str, weight: float) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)) * weight


def parse_quality(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Score of a parsed invoice: header fields, line coverage, checks, template bonus."""
    joined = invoices.withColumnRenamed("id", "invoice_id").join(
        _line_coverage(lines), "invoice_id", "left"
    )
    has_lines = F.coalesce(F.col("_n") > 0, F.lit(False))
    parts = [
        _points(_present("invoice_no"), 0.10),
        _points(F.col("invoice_date").isNotNull(), 0.10),
        _points(_present("seller_name"), 0.10),
        _points(_present("buyer_name") | F.coalesce(F.col("total_amount") > 0, F.lit(False)), 0.10),
        _points(has_lines, 0.10),
        _ratio("_qty", 0.15),
        _ratio("_price", 0.15),
        _ratio("_hs", 0.10),
        _points(F.coalesce("_math", F.lit(True)), 0.10),
    ]
    if "template_confidence" in invoices.columns:
        parts.append(_ratio("template_confidence", 0.10))
    return joined.select(
        "invoice_id", clamp01(reduce(lambda a, b: a + b, parts)).alias("quality_score")
    )


def extraction_quality(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Score of an invoice read from a model response."""
    joined = invoices.withColumnRenamed("id", "invoice_id").join(
        _line_coverage(lines), "invoice_id", "left"
    )
    parts = [
        _points(_present("invoice_no"), 0.15),
        _points(F.col("invoice_date").isNotNull(), 0.10),
        _points(_present("seller_name"), 0.10),
        _points(F.coalesce(F.col("total_amount") > 0, F.lit(False)), 0.15),
        _points(F.coalesce(F.col("_n") > 0, F.lit(False)), 0.15),
        _ratio("_qty", 0.15),
        _ratio("_any_price", 0.20),
    ]
    return joined.select(
        "invoice_id", clamp01(reduce(lambda a, b: a + b, parts)).alias("extraction_score")
    )


def item_completeness() -> Column:
    """Score of one line from the presence of its five fields."""
    return (
        _points(_present("item_name"), 0.20)
        + _points(F.coalesce(F.col("quantity") > 0, F.lit(False)), 0.25)
        + _points(F.coalesce(F.col("unit_price") > 0, F.lit(False)), 0.25)
        + _points(F.coalesce(F.col("total_price") > 0, F.lit(False)), 0.20)
        + _points(_present("hs_code"), 0.10)
    )


def match_coverage(items: DataFrame) -> DataFrame:
    """Line items, matched and unmatched, per invoice."""
    linked = F.coalesce(F.col("matched_material_id") != "", F.lit(False))
    return (
        items.filter("row_type = 'line_item'")
        .groupBy("invoice_id")
        .agg(
            F.count(F.lit(1)).alias("total_items"),
            F.count_if(linked).alias("matched"),
            F.count_if(~linked).alias("unmatched"),
        )
    )


def status_counts(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """One row: all rows and how many carry each status."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(column) == value).alias(value) for value in wanted],
    )


def index_statistics(entries: DataFrame) -> DataFrame:
    """Size and last id per index."""
    return entries.groupBy("index_name").agg(
        F.count(F.lit(1)).alias("entries"), F.max("id").alias("last_id")
    )


def one_row(*counts: DataFrame) -> DataFrame:
    """Join one-row aggregates side by side."""
    return reduce(lambda a, b: a.crossJoin(b), counts)
