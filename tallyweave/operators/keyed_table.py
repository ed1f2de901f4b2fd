"""A table in buckets of its key: a change rewrites the buckets it touches, no others.

Layout: a folder per bucket, ``bucket = hash(key) mod buckets``. An upsert or delete first
finds the buckets of its keys (at most as many numbers as there are buckets), reads those by
partition pruning, and replaces them by a dynamic partition overwrite. Files of other buckets
stay as they are. A write that was cut short leaves some touched buckets old and some new;
running the same change again ends in the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tallyweave.operators.merge import merge_upsert
from tallyweave.session import cut_lineage

BUCKET = "bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of `schema` under unique `keys` in the shared folder `path`."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64

    @staticmethod
    def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
        """Write all rows of `df` once, a task per bucket."""
        table = KeyedTable(df.sparkSession, path, df.schema, tuple(keys), buckets)
        table._replace(df)
        return table

    def rows(self) -> DataFrame:
        return self._bucketed().drop(BUCKET)

    def upsert(self, changes: DataFrame, order: Column, keep_if_null: list[str] | None = None,
               fill_only: list[str] | None = None) -> list[int]:
        """Merge `changes` as `merge.merge_upsert` does; returns the buckets written."""
        dealt = cut_lineage(changes.withColumn("_order", order).withColumn(BUCKET, self._bucket(self.keys)))
        touched = self._numbers(dealt)
        merged = merge_upsert(self._some(touched), dealt, list(self.keys), F.col("_order"), keep_if_null, fill_only)
        return self._rewrite(merged, touched)

    def delete(self, gone: DataFrame) -> list[int]:
        """Remove the rows whose keys `gone` holds."""
        keys = cut_lineage(gone.select(*self.keys).distinct().withColumn(BUCKET, self._bucket(self.keys)))
        touched = self._numbers(keys)
        return self._rewrite(self._some(touched).join(keys.drop(BUCKET), list(self.keys), "left_anti"), touched)

    def cascade(self, gone: DataFrame, foreign_key: str, key: str = "id", set_null: bool = False) -> list[int]:
        """Remove the rows that refer to deleted parents, or empty their reference.

        One narrow look at (bucket, foreign key) finds the buckets that hold such a row.
        """
        parents = cut_lineage(gone.select(F.col(key).alias("_parent")).where("_parent is not null").distinct())
        refers = F.col(foreign_key) == F.col("_parent")
        touched = self._numbers(self._bucketed().select(BUCKET, foreign_key).join(parents, refers, "left_semi"))
        held = self._some(touched)
        if not set_null:
            return self._rewrite(held.join(parents, refers, "left_anti"), touched)
        emptied = held.join(parents, refers, "left").withColumn(
            foreign_key, F.when(F.col("_parent").isNull(), F.col(foreign_key)))
        return self._rewrite(emptied.select(*self.schema.names), touched)

    def _bucket(self, columns: tuple[str, ...]) -> Column:
        kinds = {f.name: f.dataType for f in self.schema}
        return F.pmod(F.xxhash64(*[F.col(c).cast(kinds[c]) for c in columns]), F.lit(self.buckets)).cast("int")

    def _numbers(self, df: DataFrame) -> list[int]:
        return sorted(r[BUCKET] for r in df.select(BUCKET).distinct().collect())

    def _bucketed(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(self.path)

    def _some(self, touched: list[int]) -> DataFrame:
        return self._bucketed().where(F.col(BUCKET).isin(touched)).drop(BUCKET)

    def _rewrite(self, rows: DataFrame, touched: list[int]) -> list[int]:
        if touched:
            # Written aside first: the buckets that are read are the ones that get replaced.
            kept = cut_lineage(rows.select(*self.schema.names))
            self._replace(kept)
            full = set(self._numbers(kept.withColumn(BUCKET, self._bucket(self.keys))))
            for number in touched:
                if number not in full:
                    self._empty(number)
        return touched

    def _replace(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names, self._bucket(self.keys).alias(BUCKET)).repartition(self.buckets, BUCKET).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _empty(self, number: int) -> None:
        """Drop the files of a bucket without rows, which an overwrite by partition leaves alone."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={number}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
