"""Ordered pages, keyset pages and user sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a list. `order` must end in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next `limit` rows behind the key `after`."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def user_order(column: str, descending: bool, tie_break: list[str]) -> list[Column]:
    """Sort keys with NULLs last in both directions."""
    c = F.col(column)
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return [first, *[F.col(t).asc_nulls_last() for t in tie_break]]


def equal_where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def search_columns(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(
            F.contains(F.lower(F.col(column)), F.lit(needle.lower())), F.lit(False)
        )
    return df.filter(hit)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in a set of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def metadata_filter(df: DataFrame, filters: dict, column: str = "metadata") -> DataFrame:
    """Equality on map entries, membership where the wanted value is a list."""
    for key, value in filters.items():
        entry = F.try_element_at(F.col(column), F.lit(key))
        if isinstance(value, (list, tuple, set)):
            df = df.filter(entry.isin([str(v) for v in value]))
        else:
            df = df.filter(entry == F.lit(str(value)))
    return df
