"""Entity coercions: raw header and line text into typed columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.dates import coerce_date
from tallyweave.functions.numbers import coerce_number
from tallyweave.functions.text import strip

HEADER_NUMBERS = ["total_amount", "subtotal", "tax_amount", "discount_amount", "total_quantity"]
LINE_NUMBERS = ["quantity", "unit_price", "total_price"]


def _text(c: str) -> Column:
    return strip(F.coalesce(F.col(c).cast("string"), F.lit("")))


def clean_headers(raw: DataFrame) -> DataFrame:
    """Amounts never NULL, dates from four formats, USD where no currency is given."""
    changes: dict[str, Column] = {
        c: coerce_number(F.col(c)) for c in HEADER_NUMBERS if c in raw.columns
    }
    changes |= {c: coerce_date(F.col(c)) for c in ("invoice_date", "due_date") if c in raw.columns}
    if "currency" in raw.columns:
        changes["currency"] = F.coalesce(F.nullif(_text("currency"), F.lit("")), F.lit("USD"))
    return raw.withColumns(changes)


def clean_lines(raw: DataFrame) -> DataFrame:
    """Amounts and texts never NULL; a line without a type is a line item."""
    changes: dict[str, Column] = {
        c: coerce_number(F.col(c)) for c in LINE_NUMBERS if c in raw.columns
    }
    changes |= {c: _text(c) for c in ("item_name", "description") if c in raw.columns}
    if "row_type" in raw.columns:
        changes["row_type"] = F.coalesce("row_type", F.lit("line_item"))
    return raw.withColumns(changes)


def compatibility_form(df: DataFrame, column: str) -> DataFrame:
    """Unicode compatibility composition (NFKC) of a text column.

    Plain ASCII is left alone; each distinct other value goes through Python once.
    """

    @F.pandas_udf("string")
    def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.str.normalize("NFKC")

    foreign = df.select(F.col(column).alias("_raw")).filter(F.col("_raw").rlike(r"[^\x00-\x7F]"))
    forms = foreign.distinct().withColumn("_form", nfkc("_raw"))
    return (
        df.join(forms, F.col(column) == F.col("_raw"), "left")
        .withColumn(column, F.coalesce("_form", column))
        .drop("_raw", "_form")
    )


def line_has_error(quantity: Column, unit_price: Column, total: Column) -> Column:
    """Entity check: the total is off by more than a cent; zeros are not judged."""
    return (total != 0.0) & (quantity != 0.0) & (F.abs(total - quantity * unit_price) > 0.01)
