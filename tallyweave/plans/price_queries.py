"""Price history, statistics, anomalies and repeat purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import audit, history
from tallyweave.plans import model
from tallyweave.plans.model import sql
from tallyweave.plans.registry import query


def history_of(spark, sf, items=None):
    items = model.invoice_items(spark, sf) if items is None else items
    return history.price_history(items, model.invoice_headers(spark, sf), model.as_of())


@query("price_history", sql("""
    SELECT item_name_normalized, hs_code, seller_name, invoice_id, invoice_date, quantity,
           rnd(unit_price) AS unit_price, currency
    FROM hist""", "hist"))
def price_history(spark, sf):
    return history_of(spark, sf).withColumn("unit_price", model.rounded("unit_price"))


_STATS_SELECT = """
    SELECT item_name_normalized, hs_code, seller_name, currency, occurrence_count,
           rnd(min_price) AS min_price, rnd(max_price) AS max_price,
           rnd(avg_price) AS avg_price, first_seen, last_seen,
           CASE WHEN min_price = max_price THEN 'stable'
                WHEN (max_price - min_price) / avg_price < 0.05 THEN 'stable'
                WHEN (max_price - min_price) / avg_price < 0.20 THEN 'moderate'
                ELSE 'volatile' END AS price_trend
    FROM stats"""


def _rounded_stats(df):
    return df.withColumns(
        {c: model.rounded(c) for c in ("min_price", "max_price", "avg_price")}
    )


@query("price_stats", sql(_STATS_SELECT, "stats"))
def price_stats(spark, sf):
    return _rounded_stats(history.price_stats(history_of(spark, sf)))


@query("price_stats_filtered", sql(
    _STATS_SELECT + " WHERE item_name_normalized LIKE '%gear%' AND lower(seller_name) LIKE '%7%'",
    "stats"))
def price_stats_filtered(spark, sf):
    return _rounded_stats(history.filter_stats(history_of(spark, sf), "gear", "7"))


@query("price_trend_counts", sql(f"""
    SELECT price_trend, count(*) AS groups, sum(occurrence_count)::BIGINT AS records
    FROM ({_STATS_SELECT}) GROUP BY 1""", "stats"))
def price_trend_counts(spark, sf):
    stats = history.price_stats(history_of(spark, sf))
    return stats.groupBy("price_trend").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("occurrence_count").alias("records")
    )


@query("price_history_filtered", sql("""
    SELECT item_name_normalized AS item_name, hs_code, seller_name, invoice_id, invoice_date,
           quantity, rnd(unit_price) AS unit_price, currency
    FROM hist
    WHERE item_name_normalized LIKE '%rod%' AND lower(seller_name) LIKE '%supplier%'
      AND invoice_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""", "hist"))
def price_history_filtered(spark, sf):
    found = history.filter_history(
        history_of(spark, sf), "rod", "Supplier", "1997-01-01", "1998-12-31"
    )
    return found.withColumn("unit_price", model.rounded("unit_price"))


@query("link_material", sql("""
    SELECT h.item_name_normalized, h.invoice_id, h.invoice_date, h.quantity, h.seller_name,
           rnd(h.unit_price) AS unit_price, m.id AS material_id
    FROM hist h LEFT JOIN mat m ON m.normalized_name = h.item_name_normalized
        AND m.hs_code <> 'PROMO'""", "hist", "mat"))
def link_material(spark, sf):
    links = (
        model.materials(spark, sf)
        .filter("hs_code <> 'PROMO'")
        .select(
            F.col("normalized_name").alias("item_name_normalized"), F.col("id").alias("material_id")
        )
    )
    linked = history.link_material(history_of(spark, sf), links)
    return linked.select(
        "item_name_normalized", "invoice_id", "invoice_date", "quantity", "seller_name",
        model.rounded("unit_price").alias("unit_price"), "material_id",
    )


_ANOMALY_TAIL = """
    SELECT i.invoice_id, i.id AS item_id, i.line_number, i.item_name,
           rnd(i.unit_price) AS unit_price,
           CASE WHEN i.unit_price > p.avg_price THEN 'above' ELSE 'below' END AS direction,
           rnd(abs(i.unit_price - p.avg_price) / p.avg_price) AS deviation,
           p.occurrence_count, rnd(p.min_price) AS min_price,
           rnd(p.max_price) AS max_price, rnd(p.avg_price) AS avg_price
    FROM items i JOIN picked p ON p.name = lower(trim(i.item_name)) AND p.seller = i.seller_name
    WHERE i.unit_price > 0 AND p.occurrence_count >= 2 AND p.avg_price > 0
      AND abs(i.unit_price - p.avg_price) / p.avg_price > 0.20"""

PICK_EXACT = """
    picked AS (
        SELECT item_name_normalized AS name, seller_name AS seller, occurrence_count, min_price,
               max_price, avg_price
        FROM (SELECT *, row_number() OVER (PARTITION BY item_name_normalized, seller_name
                  ORDER BY occurrence_count DESC, hs_code, currency) AS rn FROM stats)
        WHERE rn = 1)"""


def anomalies(spark, sf, match="exact"):
    items = model.invoice_items(spark, sf, model.lines_with_parts(spark, sf))
    stats = history.price_stats(history_of(spark, sf, items))
    found = audit.price_anomalies(items, stats, match=match)
    rounded = ("unit_price", "deviation", "min_price", "max_price", "avg_price")
    return found.withColumns({c: model.rounded(c) for c in rounded})


@query("price_anomaly", sql(_ANOMALY_TAIL, "stats", extra=PICK_EXACT))
def price_anomaly(spark, sf):
    return anomalies(spark, sf)


@query("price_anomaly_contains", sql(_ANOMALY_TAIL, "stats", extra="""
    wanted AS (SELECT DISTINCT lower(trim(item_name)) AS name, seller_name AS seller FROM items),
    picked AS (
        SELECT name, seller, occurrence_count, min_price, max_price, avg_price
        FROM (SELECT w.name, w.seller, s.*, row_number() OVER (PARTITION BY w.name, w.seller
                  ORDER BY occurrence_count DESC, item_name_normalized, hs_code, seller_name,
                           currency) AS rn
              FROM wanted w JOIN stats s ON contains(s.item_name_normalized, w.name)
                   AND contains(lower(s.seller_name), lower(w.seller)))
        WHERE rn = 1)"""))
def price_anomaly_contains(spark, sf):
    return anomalies(spark, sf, "contains")


@query("cross_invoice_duplicates", sql("""
    SELECT i.invoice_id, i.id AS item_id, i.line_number, i.item_name, i.seller_name,
           v.invoice_date, count(*) AS prior_records,
           string_agg(DISTINCT CAST(h.invoice_date AS VARCHAR), ', '
                      ORDER BY CAST(h.invoice_date AS VARCHAR)) AS prior_dates
    FROM items i JOIN hdr v ON v.id = i.invoice_id
    JOIN hist h ON h.item_name_normalized = lower(trim(i.item_name))
        AND h.seller_name = i.seller_name
        AND h.invoice_date BETWEEN v.invoice_date - 30 AND v.invoice_date - 1
    GROUP BY ALL""", "items", "hdr", "hist"))
def cross_invoice_duplicates(spark, sf):
    items = model.invoice_items(spark, sf, model.lines_with_parts(spark, sf, "l_orderkey"))
    found = audit.repeat_purchases(
        items, model.invoice_headers(spark, sf), history_of(spark, sf, items)
    )
    return found.withColumn(
        "prior_dates", F.array_join(F.col("prior_dates").cast("array<string>"), ", ")
    )
