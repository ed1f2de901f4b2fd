"""Joined views over documents, invoices, lines, chunks and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame) -> DataFrame:
    return df.filter("is_latest")


def mark_latest(versions: DataFrame) -> DataFrame:
    """A version is current until another one names it as its predecessor."""
    replaced = (
        versions.filter(F.col("previous_version_id").isNotNull())
        .select(F.col("previous_version_id").alias("id"), F.lit(True).alias("_replaced"))
        .distinct()
    )
    return (
        versions.drop("is_latest")
        .join(replaced, "id", "left")
        .withColumn("is_latest", F.col("_replaced").isNull())
        .drop("_replaced")
    )


def documents_with_invoices(
    documents: DataFrame, invoices: DataFrame, audits: DataFrame
) -> DataFrame:
    current = latest(invoices).select(
        "doc_id", F.col("id").alias("invoice_id"), "invoice_no", "invoice_date", "total_amount"
    )
    verdicts = audits.select("invoice_id", F.col("status").alias("audit_status"))
    return (
        latest(documents)
        .select(F.col("id").alias("doc_id"), "filename", F.col("status").alias("doc_status"),
                "company_key")
        .join(current, "doc_id", "left")
        .join(verdicts, "invoice_id", "left")
    )


def searchable_chunks(chunks: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    current = latest(documents).select(F.col("id").alias("doc_id"), "filename", "company_key")
    page = pages.select(F.col("id").alias("page_id"), "page_no", "page_type")
    return chunks.join(current, "doc_id").join(page, "page_id", "left")


def searchable_items(items: DataFrame, invoices: DataFrame, documents: DataFrame) -> DataFrame:
    header = latest(invoices).select(
        F.col("id").alias("invoice_id"), "doc_id", "invoice_no", "invoice_date"
    )
    names = documents.select(F.col("id").alias("doc_id"), "filename")
    # Headers meet their documents first, so that the lines are shuffled for one join only.
    filed = header.join(names, "doc_id", "left")
    return items.filter("row_type = 'line_item'").withColumnRenamed("id", "item_id").join(filed, "invoice_id")


def audit_summary(audits: DataFrame, invoices: DataFrame, documents: DataFrame) -> DataFrame:
    header = invoices.select(F.col("id").alias("invoice_id"), "doc_id", "invoice_no")
    names = documents.select(F.col("id").alias("doc_id"), "filename")
    return (
        audits.withColumnRenamed("id", "audit_id")
        .join(header, "invoice_id")
        .join(names, "doc_id", "left")
    )


def pending_after(rows: DataFrame, parents: DataFrame, parent_key: str, mark: Column) -> DataFrame:
    """Rows of current parents behind a high-water mark (NULL mark: all of them)."""
    current = latest(parents).select(F.col("id").alias(parent_key))
    behind = rows.filter(mark.isNull() | (F.col("id") > mark))
    return behind.join(current, parent_key, "left_semi")


def unmatched_items(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Named line items of current invoices that no material is linked to."""
    open_items = items.filter(
        (F.col("row_type") == "line_item")
        & F.coalesce(F.col("matched_material_id") == "", F.lit(True))
        & (F.col("item_name") != "")
    )
    return open_items.join(
        latest(invoices).select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi"
    )


def hits_with_chunks(hits: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Keyword hits with their chunk text and page."""
    page = pages.select(F.col("id").alias("page_id"), "page_no", "page_type")
    return hits.join(chunks, "chunk_id").join(page, "page_id", "left")


def hits_with_items(hits: DataFrame, items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Keyword hits with line values; header columns are NULL for superseded invoices."""
    header = latest(invoices).select(F.col("id").alias("invoice_id"), "invoice_no", "invoice_date")
    return hits.join(items, "item_id").join(header, "invoice_id", "left")


def drop_orphan_vectors(vectors: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(entities.select(key), key, "left_semi")


def nest_children(
    children: DataFrame, parent_key: str, position: Column, fields: list[str], page_size: int
) -> DataFrame:
    """Children of each parent as ordered arrays of at most `page_size` positions.

    An ordinary parent has exactly one row (page 0); a huge one is spread over
    pages, so no task has to hold all of its children. `position` counts from 1.
    """
    page = F.floor((position - 1) / page_size).cast("long")
    return (
        children.groupBy(F.col(parent_key), page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    )
