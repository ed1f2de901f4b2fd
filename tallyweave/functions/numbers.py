"""Numeric expressions: parsing, coercion, rule arithmetic and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.binding import let


def parse_number(c: Column) -> Column:
    """Number from text in either locale; NULL when nothing numeric is left.

    When the last comma comes after the last dot, the comma is the decimal mark.
    """

    def plain(packed: Column) -> Column:
        last_comma = F.locate(",", F.reverse(packed))
        last_dot = F.locate(".", F.reverse(packed))
        comma_decimal = (last_comma > 0) & ((last_dot == 0) | (last_comma < last_dot))
        return F.when(
            comma_decimal, F.translate(F.translate(packed, ".", ""), ",", ".")
        ).otherwise(F.translate(packed, ",", ""))

    digits = F.regexp_replace(let(F.translate(c, " ", ""), plain), r"[^\d.\-]", "")
    return digits.try_cast("double")


def coerce_number(c: Column) -> Column:
    """Entity rule for amounts: anything unusable becomes 0.0."""
    value = F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value)
    return F.when(usable, value).otherwise(F.lit(0.0))


def line_total(quantity: Column, unit_price: Column) -> Column:
    return F.round(quantity * unit_price, 2)


def line_total_ok(quantity: Column, unit_price: Column, total: Column) -> Column:
    return F.abs(total - line_total(quantity, unit_price)) <= 0.01


def infer_unit_price(quantity: Column, unit_price: Column, total: Column) -> Column:
    """Total over quantity where no price was read."""
    missing = F.coalesce(unit_price, F.lit(0.0)) == 0.0
    return F.when(
        missing & (quantity > 0) & (total > 0), F.try_divide(total, quantity)
    ).otherwise(unit_price)


def relative_deviation(value: Column, reference: Column) -> Column:
    return F.try_divide(F.abs(value - reference), reference)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def price_text_value(c: Column) -> Column:
    """Number inside a price text such as "AED 1,299.00"."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\d.,]", ""), ",", "").try_cast("double")


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy; the zero vector stays zero."""
    norm = l2_norm(vector)
    return F.transform(
        vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float")
    )
