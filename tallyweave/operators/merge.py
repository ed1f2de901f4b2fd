"""Batch upserts and keyed deletes as table-to-table functions.

The result is a new DataFrame; write it to a new path, never over its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_per_key(changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last change per key, by a combinable aggregate."""
    row = F.struct(*[F.col(c) for c in changes.columns if c not in keys])
    grouped = changes.groupBy(*keys).agg(F.max_by(row, order).alias("_row"))
    return grouped.select(*keys, "_row.*")


def merge_upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: list[str],
    order: Column,
    keep_if_null: list[str] | None = None,
    fill_only: list[str] | None = None,
) -> DataFrame:
    """Insert new keys and replace known ones with their newest change.

    `keep_if_null`: a NULL change keeps the old value.
    `fill_only`: a change only fills a NULL or empty old value.
    Rows without a change stay as they are.
    """
    keep_if_null, fill_only = keep_if_null or [], fill_only or []
    last = newest_per_key(changes, keys, order).select(*base.columns)
    values = [c for c in base.columns if c not in keys]
    left = base.select(*keys, F.struct(*values).alias("_old"))
    right = last.select(*keys, F.struct(*values).alias("_new"))

    def pick(c: str) -> Column:
        old, new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if c in fill_only:
            blank = F.coalesce(old.cast("string") == "", F.lit(True))
            value = F.when(blank & F.col("_new").isNotNull(), new).otherwise(old)
        elif c in keep_if_null:
            value = F.coalesce(new, old)
        else:
            value = F.when(F.col("_new").isNull(), old).otherwise(new)
        return value.alias(c)

    return left.join(right, keys, "full_outer").select(*keys, *[pick(c) for c in values])


def delete_keys(base: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    return base.join(deletes.select(key).distinct(), key, "left_anti")


def cascade_delete(child: DataFrame, deletes: DataFrame, foreign_key: str, key: str = "id") -> DataFrame:
    """Remove the children of deleted parents."""
    gone = deletes.select(F.col(key).alias(foreign_key)).distinct()
    return child.join(gone, foreign_key, "left_anti")


def cascade_set_null(
    child: DataFrame, deletes: DataFrame, foreign_key: str, key: str = "id"
) -> DataFrame:
    """Keep the children of deleted parents, without the reference."""
    gone = deletes.select(F.col(key).alias(foreign_key), F.lit(True).alias("_gone")).distinct()
    columns = child.columns
    return (
        child.join(gone, foreign_key, "left")
        .withColumn(foreign_key, F.when(F.col("_gone").isNull(), F.col(foreign_key)))
        .select(*columns)
    )
