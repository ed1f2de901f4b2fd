"""Data-quality rules: references, domains, uniqueness, required values.

Rules become entries on the table they look at. A table is read once, whatever the
number of its rules: every row hands on its keys and faults as one array. All
keys of all tables then meet in one aggregation by rule and key.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas


class Entry(NamedTuple):
    """Rows of `df` where `when` holds hand on `key` in a role: child, parent, unique or fault."""

    df: DataFrame
    rule: str
    role: str
    when: Column
    key: Column


def orphans(
    rule: str, child: DataFrame, column: str, parent: DataFrame, parent_column: str = "id"
) -> list[Entry]:
    """Children whose reference is set but has no parent."""
    kind = dict(parent.dtypes)[parent_column]
    return [
        Entry(child, rule, "child", F.col(column).isNotNull(), F.col(column).try_cast(kind)),
        Entry(parent, rule, "parent", F.col(parent_column).isNotNull(), F.col(parent_column)),
    ]


def outside_domain(rule: str, df: DataFrame, column: str, allowed: list[str]) -> list[Entry]:
    """Values that are set and none of those allowed."""
    return [Entry(df, rule, "fault", ~F.col(column).isin(allowed), F.lit(None))]


def repeated(rule: str, df: DataFrame, keys: list[str]) -> list[Entry]:
    """Keys that several rows hold; NULL counts as a value."""
    key = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    return [Entry(df, rule, "unique", F.lit(True), key)]


def missing(rules: dict[str, str], df: DataFrame) -> list[Entry]:
    """NULL or empty required columns."""
    return [
        Entry(df, rule, "fault", F.coalesce(F.col(c).cast("string") == "", F.lit(True)), F.lit(None))
        for rule, c in rules.items()
    ]


def _handed_on(entries: list[Entry]) -> DataFrame:
    """(rule, role, key) of the entries of one table, in one pass over it."""
    each = [
        F.when(e.when, F.struct(F.lit(e.rule).alias("rule"), F.lit(e.role).alias("role"),
                                e.key.cast("string").alias("key")))
        for e in entries
    ]
    return entries[0].df.select(F.explode(F.array_compact(F.array(*each))).alias("_e")).select("_e.*")


def report(entries: list[Entry]) -> DataFrame:
    """(rule, violations) of every rule, 0 where nothing is wrong.

    Faults share a key per rule, but are counted before the shuffle.
    """
    tables: dict[int, list[Entry]] = {}
    for entry in entries:
        tables.setdefault(id(entry.df), []).append(entry)
    spark = entries[0].df.sparkSession
    rules = spark.createDataFrame(
        [(rule, "rule", None) for rule in dict.fromkeys(e.rule for e in entries)],
        "rule string, role string, key string",
    )
    found = reduce(DataFrame.unionByName, [_handed_on(of) for of in tables.values()], rules)

    def rows(role: str) -> Column:
        return F.count_if(F.col("role") == role)

    per_key = found.groupBy("rule", "key").agg(
        rows("child").alias("children"), rows("parent").alias("parents"),
        rows("unique").alias("uses"), rows("fault").alias("faults"),
    )
    wrong = (
        F.when(F.col("parents") == 0, F.col("children")).otherwise(0)
        + F.when(F.col("uses") > 1, 1).otherwise(0)
        + F.col("faults")
    )
    return per_key.groupBy("rule").agg(F.sum(wrong).alias("violations"))


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Every reference and domain rule of the schema that the given tables can answer."""
    entries: list[Entry] = []
    for fk in schemas.FOREIGN_KEYS:
        if fk.child in tables and fk.parent in tables:
            entries += orphans(f"fk:{fk.child}.{fk.column}", tables[fk.child], fk.column,
                               tables[fk.parent], fk.parent_column)
    for (name, column), allowed in schemas.DOMAINS.items():
        if name in tables and column in tables[name].columns:
            entries += outside_domain(f"domain:{name}.{column}", tables[name], column, allowed)
    for name, df in tables.items():
        key = "session_id" if name == "chat_sessions" else "id"
        if key in df.columns:
            entries += repeated(f"unique:{name}.{key}", df, [key])
    return report(entries)


def missing_values(required: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Required values that do not occur (a set difference)."""
    return required.select(column).subtract(present.select(column))
