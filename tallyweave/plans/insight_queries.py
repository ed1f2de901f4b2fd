"""Insights and the reminders they raise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import history, insights, views
from tallyweave.plans import model
from tallyweave.plans.model import AS_OF, sql
from tallyweave.plans.price_queries import history_of
from tallyweave.plans.registry import query


def all_insights(spark, sf):
    items = model.invoice_items(spark, sf, model.lines_with_parts(spark, sf, "l_orderkey"))
    current = views.latest(model.invoice_headers(spark, sf)).select(F.col("id").alias("invoice_id"))
    return insights.all_insights(
        model.company_documents(spark, sf),
        views.unmatched_items(items, model.invoice_headers(spark, sf)),
        items.join(current, "invoice_id", "left_semi"),
        history.price_stats(history_of(spark, sf, items)),
        model.as_of(),
    )


def _figure(value: str) -> str:
    """Half up on the digits that the number prints, without the last bits of a sum."""
    return f"CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(28, 9)) AS DECIMAL(18, 6))"


_INSIGHTS = f"""
    open_items AS (SELECT i.* FROM items i JOIN hdr h ON h.id = i.invoice_id AND h.is_latest),
    best AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY item_name_normalized
        ORDER BY occurrence_count DESC, hs_code, seller_name, currency) = 1),
    found AS (
        SELECT 'expiring_document' AS category, CASE WHEN expiry_date - DATE '{AS_OF}' <= 7
               THEN 'critical' ELSE 'warning' END AS severity, 'Expiring: ' || title AS title,
               title || ' expires on ' || expiry_date || ' (' || (expiry_date - DATE '{AS_OF}')
                   || ' days remaining)' AS message,
               expiry_date AS suggested_due_date, 'company_document' AS linked_entity_type,
               CAST(id AS VARCHAR) AS linked_entity_id
        FROM cdoc WHERE expiry_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30
        UNION ALL
        SELECT 'unmatched_item', 'info', 'Unmatched item: ' || arg_max(item_name, id),
               printf('Item ''%s'' has no matched material in the catalog', arg_max(item_name, id)), NULL,
               'invoice_item', max(id)
        FROM open_items WHERE matched_material_id IS NULL GROUP BY lower(item_name)
        UNION ALL
        SELECT 'price_anomaly', 'warning', 'Price anomaly: ' || i.item_name,
               printf('''%s'' priced at %s deviates %s%% from average %s', i.item_name, {_figure('i.unit_price')}::DOUBLE::VARCHAR,
                      CAST({_figure('abs(i.unit_price - b.avg_price) / b.avg_price * 100')} AS DECIMAL(18, 1))::VARCHAR,
                      {_figure('b.avg_price')}::DOUBLE::VARCHAR), NULL, 'invoice_item',
               i.id
        FROM open_items i JOIN best b ON b.item_name_normalized = lower(i.item_name)
        WHERE b.occurrence_count >= 2 AND i.unit_price > 0
          AND abs(i.unit_price - b.avg_price) / b.avg_price > 0.2)"""
_TABLES = ("items", "hdr", "stats", "cdoc", "rem")


@query("insights", sql("SELECT * FROM found", *_TABLES, extra=_INSIGHTS))
def insight_rows(spark, sf):
    return all_insights(spark, sf)


@query("insight_counts", sql("SELECT category, count(*) AS insights FROM found GROUP BY 1",
                             *_TABLES, extra=_INSIGHTS))
def insight_counts(spark, sf):
    return insights.insight_counts(all_insights(spark, sf))


@query("new_reminders", sql(f"""
    SELECT title, message, coalesce(suggested_due_date, DATE '{AS_OF}' + 7) AS due_date,
           linked_entity_type, linked_entity_id
    FROM found f WHERE NOT EXISTS (SELECT 1 FROM rem r WHERE NOT r.is_done
        AND r.linked_entity_type = f.linked_entity_type
        AND CAST(r.linked_entity_id AS VARCHAR) = f.linked_entity_id)""", *_TABLES, extra=_INSIGHTS))
def new_reminders(spark, sf):
    return insights.new_reminders(all_insights(spark, sf), model.reminders(spark, sf), model.as_of())


@query("linked_reminders", sql("""
    SELECT id, title, is_done FROM rem WHERE linked_entity_id IN (
        SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""", "rem"))
def linked_reminders(spark, sf):
    entities = model.table(spark, sf, "lineitem").filter("l_quantity >= 49").select(
        F.lit("company_document").alias("linked_entity_type"),
        F.col("l_orderkey").alias("linked_entity_id"),
    )
    return insights.by_linked_entity(model.reminders(spark, sf), entities).select(
        "id", "title", "is_done"
    )


@query("company_document_list", sql("""
    SELECT id, title, expiry_date FROM cdoc ORDER BY expiry_date ASC NULLS LAST, id
    LIMIT 100 OFFSET 50""", "cdoc"))
def company_document_list(spark, sf):
    from tallyweave.operators.paging import ordered_page, user_order

    documents = model.company_documents(spark, sf).select("id", "title", "expiry_date")
    return ordered_page(documents, user_order("expiry_date", False, ["id"]), 100, 50)
