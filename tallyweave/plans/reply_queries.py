"""Texts, files and model replies made from the tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import audit, extraction
from tallyweave.operators.partitioning import fan_out
from tallyweave.plans import model
from tallyweave.plans.extract_queries import _EXPECTED_ITEMS
from tallyweave.plans.model import sql
from tallyweave.plans.registry import query
from tallyweave.sources import files


@query("decoded_documents", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def decoded_documents(spark, sf):
    """Documents stored in UTF-8 or, where it can hold them, in Latin-1."""
    plain = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\x00-\xff]")
    stored = model.table(spark, sf, "documents").filter("text IS NOT NULL").select(
        "doc_id",
        F.when(plain, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    return stored.select("doc_id", F.md5(files.decode_text(F.col("content"))).alias("text_md5"))


@query("new_files", """
    WITH f AS (SELECT sha256(text) AS file_hash, 'inbox/' || lpad(doc_id::VARCHAR, 12, '0') AS file_path,
                      length(text) AS file_size, source FROM documents WHERE text IS NOT NULL)
    SELECT file_hash, min(file_path) AS file_path, arg_min(file_size, file_path) AS file_size FROM f
    WHERE source IS DISTINCT FROM 'src0'
      AND file_hash NOT IN (SELECT file_hash FROM f WHERE source = 'src0') GROUP BY 1""")
def new_files(spark, sf):
    """Files of all sources but one whose content that source's documents do not hold."""
    found = model.table(spark, sf, "documents").filter("text IS NOT NULL").select(
        F.sha2("text", 256).alias("file_hash"),
        F.concat(F.lit("inbox/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("file_path"),
        F.col("source").alias("filename"), F.length("text").cast("long").alias("file_size"), "text",
        (F.col("source") == "src0").alias("is_latest"),
    )
    incoming = found.filter(~F.coalesce("is_latest", F.lit(False))).drop("is_latest")
    return files.new_files(incoming, found).select("file_hash", "file_path", "file_size")


def invoice_replies(spark, sf):
    """Invoices as JSON replies: plain, in a code fence, or between other words."""
    lines = model.invoice_items_listed(spark, sf)
    item = F.struct(
        F.concat(F.lit("1. "), "item_name").alias("description"),
        F.format_string("%.0f", "quantity").alias("quantity"),
        F.format_number("unit_price", 2).alias("unit_price"),
        F.format_number("total_price", 2).alias("total_price"),
    )
    nested = fan_out(lines, "invoice_id").groupBy("invoice_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("line_number", "id", item.alias("item")))), lambda x: x["item"]
        ).alias("items")
    )
    body = F.to_json(F.struct(F.concat(F.lit("INV-"), "invoice_id").alias("invoice_no"), "items"))
    pick = F.col("invoice_id") % 3
    reply = (
        F.when(pick == 0, body)
        .when(pick == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
    )
    return nested.select(F.col("invoice_id").alias("doc_id"), reply.alias("response"))


@query("reply_items", sql("""
    SELECT doc_id, 'INV-' || doc_id AS invoice_no, line_number, item_name, quantity, unit_price,
           total_price FROM expected""", "listed", extra=_EXPECTED_ITEMS))
def reply_items(spark, sf):
    parsed = extraction.parse_replies(invoice_replies(spark, sf))
    return parsed.filter("valid").select("doc_id", "invoice_no", F.explode("items").alias("i")).select(
        "doc_id", "invoice_no", "i.line_number", "i.item_name", "i.quantity", "i.unit_price", "i.total_price"
    )


@query("review_findings", f"""
    SELECT l_orderkey AS invoice_id, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'warning' END
           AS severity, 'Discount of line ' || {model._KEY} AS message,
           'items[' || (l_linenumber - 1) || ']' AS field
    FROM lineitem WHERE l_discount > 0.05""")
def review_findings(spark, sf):
    """Reviews written as free text around a JSON list, one per order."""
    finding = F.struct(
        F.concat(F.lit("Discount of line "), model.line_key()).alias("issue"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("info").alias("severity"),
        F.col("l_linenumber").cast("int").alias("line"),
    )
    found = F.collect_list(F.when(F.col("l_discount") > 0.05, finding))
    reviews = model.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id")).agg(
        F.concat(F.lit("I looked at it.\n"), F.to_json(found), F.lit("\nThat is all.")).alias("response")
    )
    return audit.parse_findings(reviews).select("invoice_id", "severity", "message", "field")
