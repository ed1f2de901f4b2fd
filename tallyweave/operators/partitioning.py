"""Partition counts, and what a query need not shuffle twice or at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tasks(df: DataFrame) -> int:
    session = df.sparkSession
    return max(
        session.sparkContext.defaultParallelism,
        int(session.conf.get("spark.sql.shuffle.partitions")),
    )


def spread(df: DataFrame) -> DataFrame:
    """Share out rows that are slow to process when the source has fewer splits than cores.

    Large sources have enough splits and pass through unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys for a grouping whose result is small but slow to process.

    The count is given, so adaptive execution does not merge the partitions again;
    the grouping that follows needs no further shuffle.
    """
    return df.repartition(_tasks(df), *keys)


def is_small(df: DataFrame, most_bytes: int = 32 << 20) -> bool:
    """True if the rows of `df` fit `most_bytes`, so that every task may get them.

    They are measured by a pass over `df`, not taken from its files: a field counts
    eight bytes, a text its length besides.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    row = sum(texts, F.lit(8 * (len(df.columns) + 1)))
    return (df.agg(F.sum(row).alias("size")).first()["size"] or 0) <= most_bytes


def small_side(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """The side of a join that goes to every task if it is small, else as it is."""
    return F.broadcast(df) if is_small(df, most_bytes) else df


def unfiltered(df: DataFrame) -> DataFrame:
    """`df` as it is; a filter set behind it is not moved in front of it.

    Spark shuffles for one part of a query what another has shuffled only if both
    ask for the same, but it moves the filters of each part, also those its joins
    imply, down to the scans. None passes an explode of what hangs on the task.
    """
    return df.withColumn("_task", F.explode(F.array(F.spark_partition_id()))).drop("_task")


def shared(df: DataFrame, *keys: str) -> DataFrame:
    """`df` as it is, where several parts of one query read it; dealt by `keys`, if any.

    As `unfiltered`, and all columns come along whichever a part needs, so parts have
    all shuffles of `df` in common, and joins and groups by `keys` need none of their own.
    """
    dealt = df.repartition(*keys) if keys else df
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest, F.spark_partition_id().alias("_task"))
    exploded = dealt.select(*keys, F.explode(F.array(row)).alias("_row"))
    # The filter is always true. A part that needs a single column would otherwise get the others pruned.
    return exploded.filter("_row._task >= 0").select(*keys, *[f"_row.{c}" for c in rest])
