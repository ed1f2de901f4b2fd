"""Incremental indexing: each micro-batch becomes chunks, vectors and keyword postings at once.

A batch is written under its number to three places and counts once its commit exists; readers
look at committed numbers only. Replaying a number after a crash replaces what was cut short
and leaves a finished batch alone, so chunks, vectors and keywords never drift apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.chunks import chunk_documents
from tallyweave.operators.stored_index import KeywordIndex
from tallyweave.session import cut_lineage

CHUNKS = "doc_id bigint, chunk_index int, chunk_text string, id string"


@dataclass(frozen=True)
class DocumentIndex:
    """Chunks, vectors and keywords of documents in a shared folder.

    `vectors` turns chunks (id, chunk_text, ...) into (id, embedding) rows; without it no
    vectors are kept.
    """

    spark: SparkSession
    path: str
    size: int = 512
    overlap: int = 50
    vectors: Callable[[DataFrame], DataFrame] | None = None

    def keywords(self) -> KeywordIndex:
        """Keywords of chunks; a hit's doc_id is the chunk id. Its commits are those of the batch."""
        return KeywordIndex(self.spark, f"{self.path}/keywords", id_type="string")

    def write_batch(self, pages: DataFrame, batch: int) -> None:
        """Index the pages (doc_id, page_no, page_type, text, ...) of one batch; for `foreachBatch`."""
        if batch in self.keywords().batches():
            return
        found = chunk_documents(pages, self.size, self.overlap).select("doc_id", "chunk_index", "chunk_text")
        pieces = cut_lineage(found.withColumn("id", F.concat_ws(":", "doc_id", "chunk_index")))
        pieces.write.mode("overwrite").parquet(f"{self.path}/chunks/batch={batch}")
        if self.vectors is not None:
            self.vectors(pieces).write.mode("overwrite").parquet(f"{self.path}/vectors/batch={batch}")
        # Last, as its commit makes the whole batch visible.
        self.keywords().append(batch, pieces.select(F.col("id").alias("doc_id"), F.col("chunk_text").alias("text")))

    def follow(self, pages: DataFrame, checkpoint: str):
        """Index what has arrived in a stream, batch by batch, then stop. A new checkpoint and a
        new folder make a rebuild."""
        return pages.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start()

    def chunks(self) -> DataFrame:
        return self._committed("chunks", CHUNKS)

    def vector_rows(self, schema: str = "id string, embedding array<float>") -> DataFrame:
        return self._committed("vectors", schema)

    def state(self) -> DataFrame:
        """(batch, chunks, documents, last_doc_id) of the committed batches."""
        return self.chunks().groupBy("batch").agg(
            F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.max("doc_id").alias("last_doc_id"))

    def _committed(self, table: str, schema: str) -> DataFrame:
        live = self.keywords().batches()
        if not live:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{table}").parquet(
            *[f"{self.path}/{table}/batch={b}" for b in live])
