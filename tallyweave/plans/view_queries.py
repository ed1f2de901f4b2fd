"""Views, filters, pages, upserts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.operators import merge, paging, quality, rollups, views
from tallyweave.operators import versions as versions_store
from tallyweave.operators.keyed_table import KeyedTable
from tallyweave.plans import model
from tallyweave.plans.audit_queries import AUDIT_RUNS, audit_runs
from tallyweave.plans.model import AS_OF, sql
from tallyweave.plans.registry import query
from tallyweave.session import cut_lineage
from tallyweave.streaming import jobs


def linked_invoices(spark, sf):
    """Headers filed under the document of the same number."""
    return model.invoice_headers(spark, sf).withColumn("doc_id", F.col("id"))


@query("documents_with_invoices", sql("""
    SELECT d.id AS doc_id, d.filename, d.status AS doc_status, d.company_key, i.id AS invoice_id,
           i.invoice_no, i.invoice_date, i.total_amount, r.status AS audit_status
    FROM doc d LEFT JOIN hdr i ON i.id = d.id AND i.is_latest
    LEFT JOIN runs r ON r.invoice_id = i.id WHERE d.is_latest""", "doc", "hdr", extra=AUDIT_RUNS))
def documents_with_invoices(spark, sf):
    return views.documents_with_invoices(
        model.documents(spark, sf), linked_invoices(spark, sf), audit_runs(spark, sf)
    )


@query("searchable_items", sql("""
    SELECT it.id AS item_id, it.invoice_id, it.item_name, it.hs_code, it.quantity,
           it.total_price, h.invoice_no, h.invoice_date, it.seller_name, d.filename
    FROM items it JOIN hdr h ON h.id = it.invoice_id AND h.is_latest
    LEFT JOIN doc d ON d.id = h.id WHERE it.row_type = 'line_item'""", "items", "hdr", "doc"))
def searchable_items(spark, sf):
    found = views.searchable_items(
        model.invoice_items(spark, sf), linked_invoices(spark, sf), model.documents(spark, sf)
    )
    return found.select(
        "item_id", "invoice_id", "item_name", "hs_code", "quantity", "total_price", "invoice_no",
        "invoice_date", "seller_name", "filename",
    )


@query("audit_summary", sql("""
    SELECT r.id AS audit_id, r.invoice_id, r.status, r.created_at, r.confidence, h.invoice_no,
           d.filename
    FROM runs r JOIN hdr h ON h.id = r.invoice_id LEFT JOIN doc d ON d.id = h.id""",
    "hdr", "doc", extra=AUDIT_RUNS))
def audit_summary(spark, sf):
    return views.audit_summary(
        audit_runs(spark, sf), linked_invoices(spark, sf), model.documents(spark, sf)
    ).drop("doc_id")


@query("pending_items", sql("""
    SELECT id, invoice_id, item_name, hs_code, brand, quantity, rnd(unit_price) AS unit_price
    FROM items
    WHERE id > '5' AND row_type = 'line_item' AND invoice_id IN (SELECT id FROM hdr WHERE is_latest)
    """, "items", "hdr"))
def pending_items(spark, sf):
    rows = model.invoice_items(spark, sf).filter("row_type = 'line_item'")
    found = views.pending_after(
        rows, model.invoice_headers(spark, sf), "invoice_id", F.lit("5")
    )
    return found.select("id", "invoice_id", "item_name", "hs_code", "brand", "quantity",
                        model.rounded("unit_price").alias("unit_price"))


@query("unmatched_items", sql("""
    SELECT id, invoice_id, item_name, hs_code FROM items
    WHERE row_type = 'line_item' AND coalesce(matched_material_id, '') = '' AND item_name <> ''
      AND invoice_id IN (SELECT id FROM hdr WHERE is_latest)""", "items", "hdr"))
def unmatched_items(spark, sf):
    found = views.unmatched_items(
        model.invoice_items(spark, sf), model.invoice_headers(spark, sf)
    )
    return found.select("id", "invoice_id", "item_name", "hs_code")


@query("nested_invoice_lines", sql("""
    SELECT invoice_id, CAST((line_number - 1) // 1000 AS BIGINT) AS page,
           count(*) AS line_count,
           string_agg(id, ',' ORDER BY line_number, id) AS line_ids
    FROM items GROUP BY 1, 2""", "items"))
def nested_invoice_lines(spark, sf):
    nested = views.nest_children(
        model.invoice_items(spark, sf), "invoice_id", F.col("line_number"),
        ["line_number", "id", "item_name", "quantity", "total_price"], page_size=1000,
    )
    return nested.select(
        "invoice_id", "page", F.size("children").cast("long").alias("line_count"),
        F.array_join(F.col("children.id"), ",").alias("line_ids"),
    )


@query("nested_session_messages", sql("""
    SELECT session_id, CAST(turn // 1000 AS BIGINT) AS page, count(*) AS messages,
           string_agg(role || ':' || token_count, ' ' ORDER BY turn) AS outline
    FROM msg GROUP BY 1, 2""", "msg"))
def nested_session_messages(spark, sf):
    nested = views.nest_children(
        model.chat_messages(spark, sf), "session_id", F.col("turn") + 1,
        ["turn", "role", "token_count"], page_size=1000,
    )
    outline = F.transform("children", lambda m: F.concat_ws(":", m["role"], m["token_count"]))
    return nested.select(
        "session_id", "page", F.size("children").cast("long").alias("messages"),
        F.array_join(outline, " ").alias("outline"),
    )


@query("search_invoices", sql("""
    SELECT id, invoice_no, buyer_name, seller_name FROM inv
    WHERE invoice_no ILIKE '%77%' OR buyer_name ILIKE '%77%' OR seller_name ILIKE '%77%'
    ORDER BY invoice_date DESC, id LIMIT 20""", "inv"))
def search_invoices(spark, sf):
    found = paging.search_columns(
        model.invoices(spark, sf), ["invoice_no", "buyer_name", "seller_name"], "77"
    )
    page = paging.ordered_page(found, [F.col("invoice_date").desc(), F.col("id")], 20)
    return page.select("id", "invoice_no", "buyer_name", "seller_name")


@query("list_invoices", sql("""
    SELECT id, invoice_no, company_key, total_amount FROM inv
    WHERE is_latest AND company_key = 'BUILDING'
    ORDER BY invoice_date DESC, id LIMIT 50 OFFSET 100""", "inv"))
def list_invoices(spark, sf):
    rows = paging.equal_where_given(
        views.latest(model.invoices(spark, sf)), company_key="BUILDING", currency=None
    )
    page = paging.ordered_page(rows, [F.col("invoice_date").desc(), F.col("id")], 50, 100)
    return page.select("id", "invoice_no", "company_key", "total_amount")


@query("keyset_page", sql("""
    SELECT id, invoice_no FROM hdr WHERE id > 4321 ORDER BY id LIMIT 100""", "hdr"))
def keyset_page(spark, sf):
    return paging.keyset_page(
        model.invoice_headers(spark, sf).select("id", "invoice_no"), "id", 4321, 100
    )


@query("nulls_last_page", sql("""
    SELECT id, seller_name FROM inv ORDER BY seller_name DESC NULLS LAST, id
    LIMIT 60 OFFSET 14700""", "inv"))
def nulls_last_page(spark, sf):
    order = paging.user_order("seller_name", True, ["id"])
    return paging.ordered_page(
        model.invoices(spark, sf).select("id", "seller_name"), order, 60, 14700
    )


@query("invoices_by_ids", sql("""
    SELECT id, invoice_no FROM hdr
    WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""", "hdr"))
def invoices_by_ids(spark, sf):
    ids = model.table(spark, sf, "lineitem").filter("l_quantity = 50").select(
        F.col("l_orderkey").alias("id")
    )
    return paging.by_ids(model.invoice_headers(spark, sf), ids).select("id", "invoice_no")


@query("metadata_filter", """
    SELECT event_id, user_id, event_type FROM events
    WHERE event_type IN ('view', 'click') AND CAST(json_extract(props, '$.k') AS VARCHAR) = '7'""")
def metadata_filter(spark, sf):
    rows = model.table(spark, sf, "events").withColumn(
        "metadata",
        F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(F.lit("type"), F.col("event_type")),
        ),
    )
    found = paging.metadata_filter(rows, {"type": ["view", "click"], "k": 7})
    return found.select("event_id", "user_id", "event_type")


@query("expiring_documents", sql(f"""
    SELECT id, title, expiry_date, CAST(expiry_date - DATE '{AS_OF}' AS INTEGER) AS days_left
    FROM cdoc WHERE expiry_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30""", "cdoc"))
def expiring_documents(spark, sf):
    from tallyweave.operators.insights import expiring

    return expiring(model.company_documents(spark, sf), model.as_of(), 30).select(
        "id", "title", "expiry_date", "days_left"
    )


@query("upcoming_reminders", sql(f"""
    SELECT id, title, due_date, due_date < DATE '{AS_OF}' AS is_overdue FROM rem
    WHERE NOT is_done AND due_date <= DATE '{AS_OF}' + 7""", "rem"))
def upcoming_reminders(spark, sf):
    from tallyweave.operators.insights import upcoming

    return upcoming(model.reminders(spark, sf), model.as_of(), 7).select(
        "id", "title", "due_date", "is_overdue"
    )


def document_versions(spark, sf):
    """Copies of the same text form a version chain in order of id."""
    docs = model.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash")
    )
    first = docs.groupBy("file_hash").agg(F.min("id").alias("_first"))
    return docs.join(first, "file_hash").select(
        "id", "file_hash",
        F.when(F.col("id") != F.col("_first"), F.col("_first")).alias("previous_version_id"),
    )


@query("document_versions", """
    WITH d AS (SELECT doc_id AS id, sha256(text) AS file_hash FROM documents),
    v AS (SELECT id, file_hash, min(id) OVER (PARTITION BY file_hash) AS first FROM d),
    c AS (SELECT id, file_hash, CASE WHEN id <> first THEN first END AS previous_version_id FROM v)
    SELECT id, file_hash, previous_version_id,
           id NOT IN (SELECT previous_version_id FROM c WHERE previous_version_id IS NOT NULL)
               AS is_latest
    FROM c""")
def versions(spark, sf):
    return views.mark_latest(document_versions(spark, sf))


def _chained(spark, sf):
    """Copies of a text follow each other in order of id."""
    docs = model.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"))
    return docs.withColumn("previous_version_id", F.lag("id").over(Window.partitionBy("file_hash").orderBy("id")))


_CHAIN = """
    WITH c AS (SELECT doc_id AS id, sha256(text) AS file_hash,
                      lag(doc_id) OVER w AS previous_version_id, lead(doc_id) OVER w IS NULL AS is_latest,
                      first(doc_id) OVER w AS root_id, row_number() OVER w - 1 AS depth
               FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id))"""


@query("version_store", _CHAIN + " SELECT id, file_hash, previous_version_id, is_latest FROM c")
def version_store(spark, sf):
    """The first copies of every text, then the others in two batches that replace them."""
    every = _chained(spark, sf)
    turn = F.ntile(3).over(Window.partitionBy("file_hash").orderBy("id"))
    dealt = cut_lineage(every.withColumn("turn", turn))
    store = versions_store.VersionStore.create(dealt.where("turn = 1").drop("turn"), jobs.work_folder(spark), 16)
    for batch in (2, 3):
        store.insert(dealt.where(F.col("turn") == batch).drop("turn"))
    return store.rows()


@query("current_versions", _CHAIN + " SELECT id, file_hash FROM c WHERE is_latest")
def current_versions(spark, sf):
    return version_store(spark, sf).where("is_latest").select("id", "file_hash")


@query("version_chains", _CHAIN + " SELECT id, root_id, depth FROM c")
def version_chains(spark, sf):
    return versions_store.version_chains(_chained(spark, sf))


@query("invoice_totals", sql("""
    SELECT h.id AS invoice_id, h.total_amount, coalesce(s.n, 0) AS items_count,
           rnd(coalesce(s.t, 0)) AS calculated_total, coalesce(s.q, 0) AS total_quantity,
           h.total_amount <> 0 AND abs(h.total_amount - coalesce(s.t, 0)) > h.total_amount * 0.01
               AS has_total_mismatch
    FROM hdr h LEFT JOIN (SELECT invoice_id, count(*) AS n, sum(total_price) AS t,
        sum(quantity) AS q FROM items GROUP BY 1) s ON s.invoice_id = h.id""", "hdr", "items"))
def invoice_totals(spark, sf):
    totals = rollups.invoice_totals(
        model.invoice_headers(spark, sf), model.invoice_items(spark, sf)
    )
    return totals.withColumn("calculated_total", model.rounded("calculated_total"))


@query("company_counts", sql("""
    SELECT company_key, count(*) AS invoices, count(*) FILTER (is_latest) AS current_invoices,
           sum(total_amount::DECIMAL(28, 2))::DOUBLE AS total_amount
    FROM inv GROUP BY 1""", "inv"))
def company_counts(spark, sf):
    return model.invoices(spark, sf).groupBy("company_key").agg(
        F.count(F.lit(1)).alias("invoices"),
        F.count_if("is_latest").alias("current_invoices"),
        F.sum(F.col("total_amount").cast("decimal(28,2)")).cast("double").alias("total_amount"),
    )


@query("event_counts", """
    SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS purchase,
           count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'other') AS other
    FROM events""")
def event_counts(spark, sf):
    return rollups.status_counts(model.table(spark, sf, "events"), "event_type", ["purchase", "error", "other"])


@query("document_totals", sql("""
    SELECT document_id, rnd(subtotal) AS subtotal, rnd(subtotal * 7 / 100) AS tax_amount,
           rnd(subtotal + subtotal * 7 / 100 - 10) AS total
    FROM (SELECT l_orderkey AS document_id, sum(l_quantity * p_retailprice) AS subtotal
          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"""))
def document_totals(spark, sf):
    line = model.table(spark, sf, "lineitem")
    part = model.table(spark, sf, "part")
    lines = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("document_id"), F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
    )
    totals = rollups.document_totals(lines, tax_rate=7.0, discount=10.0, digits=None)
    return totals.select("document_id", *[
        model.rounded(c).alias(c) for c in ("subtotal", "tax_amount", "total")
    ])


@query("match_coverage", sql("""
    SELECT invoice_id, count(*) AS total_items, count(matched_material_id) AS matched,
           count(*) - count(matched_material_id) AS unmatched
    FROM items GROUP BY 1""", "items"))
def match_coverage(spark, sf):
    return rollups.match_coverage(model.invoice_items(spark, sf))


@query("parse_quality", sql("""
    SELECT v.id AS invoice_id, rnd(least(1::DOUBLE, 0.2 + 0.1::DOUBLE
        * (v.seller_name IS NOT NULL)::INTEGER + 0.1::DOUBLE + CASE WHEN s.n > 0 THEN
          0.1::DOUBLE + 0.15 * s.q + 0.15 * s.p + 0.1 * s.hs ELSE 0::DOUBLE END
          + CASE WHEN coalesce(s.ok, true) THEN 0.1::DOUBLE ELSE 0::DOUBLE END)) AS quality_score
    FROM inv v LEFT JOIN (
        SELECT invoice_id, count(*) AS n, avg((quantity > 0)::INTEGER) AS q,
               avg((unit_price > 0)::INTEGER) AS p, avg((hs_code <> '')::INTEGER) AS hs,
               bool_and(abs(total_price - quantity * unit_price) <= 0.01) AS ok
        FROM listed GROUP BY 1) s ON s.invoice_id = v.id""", "inv", "listed"))
def parse_quality(spark, sf):
    scores = rollups.parse_quality(
        model.invoices(spark, sf), model.invoice_items_listed(spark, sf)
    )
    return scores.withColumn("quality_score", model.rounded("quality_score"))


@query("extraction_quality", sql("""
    SELECT v.id AS invoice_id, rnd(0.15 + 0.1::DOUBLE + 0.1::DOUBLE
        * (v.seller_name IS NOT NULL)::INTEGER + 0.15 * (v.total_amount > 0)::INTEGER
        + CASE WHEN s.n > 0 THEN 0.15::DOUBLE + 0.15 * s.q + 0.2 * s.p ELSE 0::DOUBLE END)
        AS extraction_score
    FROM inv v LEFT JOIN (
        SELECT invoice_id, count(*) AS n, avg((quantity > 0)::INTEGER) AS q,
               avg((unit_price > 0 OR total_price > 0)::INTEGER) AS p
        FROM listed GROUP BY 1) s ON s.invoice_id = v.id""", "inv", "listed"))
def extraction_quality(spark, sf):
    scores = rollups.extraction_quality(
        model.invoices(spark, sf), model.invoice_items_listed(spark, sf)
    )
    return scores.withColumn("extraction_score", model.rounded("extraction_score"))


@query("item_completeness", sql("""
    SELECT id, rnd(0.2 * (item_name <> '')::INTEGER + 0.25 * (quantity > 0)::INTEGER
        + 0.25 * (unit_price > 1000)::INTEGER + 0.2 * (total_price > 0)::INTEGER
        + 0.1 * (hs_code <> 'PROMO')::INTEGER) AS score
    FROM items""", "items"))
def item_completeness(spark, sf):
    items = model.invoice_items(spark, sf).withColumns({
        "unit_price": F.when(F.col("unit_price") > 1000, F.col("unit_price")),
        "hs_code": F.nullif(F.col("hs_code"), F.lit("PROMO")),
    })
    return items.select("id", model.rounded(rollups.item_completeness()).alias("score"))


@query("dashboard", sql(f"""
    SELECT (SELECT count(*) FROM hdr WHERE is_latest) AS invoices,
           (SELECT count(*) FROM rem WHERE NOT is_done AND due_date <= DATE '{AS_OF}' + 7)
               AS upcoming_reminders,
           (SELECT count(*) FROM cdoc
            WHERE expiry_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30) AS expiring_documents,
           (SELECT count(DISTINCT item_id) FROM mov) AS inventory_items""",
    "hdr", "rem", "cdoc", "mov"))
def dashboard(spark, sf):
    from tallyweave.operators.insights import expiring, upcoming

    def count(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    today = model.as_of()
    return rollups.one_row(
        count(views.latest(model.invoice_headers(spark, sf)), "invoices"),
        count(upcoming(model.reminders(spark, sf), today, 7), "upcoming_reminders"),
        count(expiring(model.company_documents(spark, sf), today, 30), "expiring_documents"),
        count(model.stock_movements(spark, sf).select("item_id").distinct(), "inventory_items"),
    )


def _customer_changes(spark, sf):
    """One change per order: the order's price becomes the customer's balance."""
    return model.table(spark, sf, "orders").select(
        (F.col("o_custkey") + 700).alias("id"),
        F.col("o_totalprice").alias("balance"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("segment"),
        F.col("o_orderstatus").alias("note"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("seq"),
    )


_MERGED = """
    WITH base AS (SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment,
                  CASE WHEN c_acctbal > 5000 THEN 'kept' ELSE '' END AS note FROM customer),
    changes AS (
        SELECT o_custkey + 700 AS id, o_totalprice AS balance,
               nullif(o_orderpriority, '5-LOW') AS segment, o_orderstatus AS note,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
                   o_orderkey DESC) AS rn
        FROM orders),
    last AS (SELECT * FROM changes WHERE rn = 1)
    SELECT coalesce(b.id, l.id) AS id,
           CASE WHEN l.id IS NULL THEN b.balance ELSE l.balance END AS balance,
           coalesce(l.segment, b.segment) AS segment,
           CASE WHEN l.id IS NOT NULL AND coalesce(b.note, '') = '' THEN l.note ELSE b.note END AS note
    FROM base b FULL OUTER JOIN last l ON l.id = b.id"""


@query("merge_upsert", _MERGED)
def merge_upsert(spark, sf):
    return merge.merge_upsert(
        _customer_notes(spark, sf), _customer_changes(spark, sf), ["id"], F.struct("at", "seq"),
        keep_if_null=["segment"], fill_only=["note"],
    )


def _customer_notes(spark, sf):
    return model.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 5000, "kept").otherwise("").alias("note"),
    )


@query("merge_into_buckets", _MERGED)
def merge_into_buckets(spark, sf):
    """The same upsert into a stored table, of which only the touched buckets are rewritten."""
    table = KeyedTable.create(_customer_notes(spark, sf), jobs.work_folder(spark), ["id"])
    table.upsert(_customer_changes(spark, sf), F.struct("at", "seq"), keep_if_null=["segment"], fill_only=["note"])
    return table.rows()


@query("cascade_in_buckets", sql("""
    SELECT id, invoice_id FROM items WHERE invoice_id IN (SELECT id FROM hdr WHERE is_latest)""",
    "items", "hdr"))
def cascade_in_buckets(spark, sf):
    """Lines of replaced invoices are removed from the buckets that hold such lines."""
    lines = model.invoice_items(spark, sf).select("id", "invoice_id")
    table = KeyedTable.create(lines, jobs.work_folder(spark), ["id"])
    table.cascade(model.invoice_headers(spark, sf).filter("NOT is_latest"), "invoice_id")
    return table.rows()


@query("delete_cascade", sql("""
    SELECT id, invoice_id FROM items WHERE invoice_id IN (SELECT id FROM hdr WHERE is_latest)""",
    "items", "hdr"))
def delete_cascade(spark, sf):
    gone = model.invoice_headers(spark, sf).filter("NOT is_latest")
    kept = merge.cascade_delete(model.invoice_items(spark, sf), gone, "invoice_id")
    return kept.select("id", "invoice_id")


@query("delete_set_null", sql("""
    SELECT h.id, CASE WHEN c.c_acctbal >= 0 THEN h.customer_id END AS customer_id
    FROM hdr h JOIN customer c ON c.c_custkey = h.customer_id""", "hdr"))
def delete_set_null(spark, sf):
    gone = model.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("id")
    )
    headers = model.invoice_headers(spark, sf).select("id", "customer_id")
    return merge.cascade_set_null(headers, gone, "customer_id")


@query("session_activity", """
    SELECT user_id AS session_id, max(ts) AS last_message_at FROM events GROUP BY 1""")
def session_activity(spark, sf):
    from tallyweave.operators.conversation import session_activity as activity

    return activity(model.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").alias("created_at")
    ))


@query("quality_report", sql("""
    SELECT 'fk:invoice_items.invoice_id' AS rule, count(*) AS violations FROM items
        WHERE invoice_id NOT IN (SELECT id FROM hdr)
    UNION ALL SELECT 'fk:price_history.invoice_id', count(*) FROM hist
        WHERE invoice_id NOT IN (SELECT id FROM hdr WHERE is_latest)
    UNION ALL SELECT 'domain:stock_movements.movement_type', count(*) FROM mov
        WHERE movement_type NOT IN ('in', 'adjust')
    UNION ALL SELECT 'unique:invoice_items.id', count(*) FROM (
        SELECT id FROM items GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'unique:invoice_items.invoice_id+line_number', count(*) FROM (
        SELECT invoice_id, line_number FROM items GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'required:invoices.seller_name', count(*) FROM inv
        WHERE seller_name IS NULL OR seller_name = ''
    UNION ALL SELECT 'required:invoice_items.matched_material_id', count(*) FROM items
        WHERE coalesce(matched_material_id, '') = ''""", "items", "hdr", "hist", "mov", "inv"))
def quality_report(spark, sf):
    from tallyweave.plans.price_queries import history_of

    items = model.invoice_items(spark, sf)
    headers = model.invoice_headers(spark, sf)
    return quality.report([
        *quality.orphans("fk:invoice_items.invoice_id", items, "invoice_id", headers),
        *quality.orphans("fk:price_history.invoice_id", history_of(spark, sf), "invoice_id",
                         views.latest(headers)),
        *quality.outside_domain("domain:stock_movements.movement_type",
                                model.stock_movements(spark, sf), "movement_type", ["in", "adjust"]),
        *quality.repeated("unique:invoice_items.id", items, ["id"]),
        *quality.repeated("unique:invoice_items.invoice_id+line_number", items,
                          ["invoice_id", "line_number"]),
        *quality.missing({"required:invoices.seller_name": "seller_name"},
                         model.invoices(spark, sf)),
        *quality.missing({"required:invoice_items.matched_material_id": "matched_material_id"},
                         items),
    ])
