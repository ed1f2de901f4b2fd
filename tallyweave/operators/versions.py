"""Versions of documents: a store split by currentness, and version chains of any length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from tallyweave.operators.keyed_table import BUCKET, KeyedTable
from tallyweave.operators.views import mark_latest
from tallyweave.session import cut_lineage


def version_chains(versions: DataFrame) -> DataFrame:
    """(id, root_id, depth): the first version each one goes back to, and the steps to it.

    `versions`: id, previous_version_id (null, or an id that may be missing, for a first
    version). Pointers are doubled each round, so a chain of n versions takes log2(n) joins on
    the id. A ring of versions has no first one and is an error.
    """
    known = versions.select(F.col("id").alias("_known"))
    steps = cut_lineage(versions.join(known, F.col("previous_version_id") == F.col("_known"), "left").select(
        "id", F.coalesce("_known", "id").alias("up"), F.col("_known").isNotNull().cast("int").cast("long").alias("depth")))
    total = steps.count()
    moving, reached = True, 1
    while moving:
        if reached > 2 * max(1, total):
            raise ValueError("versions form a ring")
        above = steps.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        steps = cut_lineage(steps.join(above, "up").select(
            "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("_depth") > 0).alias("moved")))
        moving = steps.where("moved").limit(1).count() > 0
        steps = steps.drop("moved")
        reached *= 2
    return steps.select("id", F.col("up").alias("root_id"), "depth")


@dataclass(frozen=True)
class VersionStore:
    """Documents (id, previous_version_id, ...) under ``is_latest=true`` and ``is_latest=false``,
    each in buckets of the id. A scan with ``WHERE is_latest`` lists current files only."""

    spark: SparkSession
    path: str
    current: KeyedTable
    past: KeyedTable

    @staticmethod
    def create(versions: DataFrame, path: str, buckets: int = 64) -> VersionStore:
        marked = cut_lineage(mark_latest(versions))
        columns = [c for c in versions.columns if c != "is_latest"]
        tables = [KeyedTable.create(marked.where(F.col("is_latest") == side).select(*columns),
                                    f"{path}/is_latest={str(side).lower()}", ["id"], buckets) for side in (True, False)]
        return VersionStore(versions.sparkSession, path, *tables)

    def insert(self, versions: DataFrame) -> list[int]:
        """Add new versions; those they replace move to the past. Returns the buckets written.

        New ids must be new. A version of the batch that another one of it replaces goes to the
        past at once. The past is written before the current side lets go, so a version is
        never in neither; running a batch again after a crash ends in the same store.
        """
        marked = cut_lineage(mark_latest(versions))
        columns = self.current.schema.names
        replaced = versions.select(F.col("previous_version_id").alias("id")).where("id is not null").distinct()
        order = F.lit(0)
        moved = cut_lineage(self.current.rows().join(replaced, "id", "left_semi"))
        gone = moved.unionByName(marked.where("NOT is_latest").select(*columns))
        touched = set(self.past.upsert(gone, order))
        touched |= set(self.current.delete(gone.select("id")))
        return sorted(touched | set(self.current.upsert(marked.where("is_latest").select(*columns), order)))

    def rows(self) -> DataFrame:
        """All versions with is_latest."""
        schema = StructType([*self.current.schema.fields]).add("is_latest", BooleanType()).add(BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(self.path).drop(BUCKET)
