"""Cleaning, text and HTML extraction, templates and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import dates, numbers, text
from tallyweave.operators import cleaning, extraction, products, templates
from tallyweave.operators.partitioning import fan_out, spread
from tallyweave.plans import model
from tallyweave.plans.model import sql
from tallyweave.plans.registry import query
from tallyweave.sources import files


@query("parse_numbers", f"SELECT {model._KEY} AS id, l_extendedprice AS plain, "
       "l_extendedprice AS european, CAST(NULL AS DOUBLE) AS none FROM lineitem")
def parse_numbers(spark, sf):
    shown = F.format_number("l_extendedprice", 2)
    return model.table(spark, sf, "lineitem").select(
        model.line_key().alias("id"),
        numbers.parse_number(F.concat(F.lit("$ "), shown)).alias("plain"),
        numbers.parse_number(F.translate(shown, ",.", ".,")).alias("european"),
        numbers.parse_number(F.col("l_returnflag")).alias("none"),
    )


@query("clean_headers", sql("""
    SELECT id, total_amount, invoice_date,
           CASE WHEN id % 7 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
           CAST(0 AS DOUBLE) AS tax_amount FROM hdr""", "hdr"))
def clean_headers(spark, sf):
    day = F.col("invoice_date")
    shapes = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy"]
    written = F.when(F.col("id") % 3 == 0, F.date_format(day, shapes[0]))
    for i in (1, 2):
        written = written.when(F.col("id") % 3 == i, F.date_format(day, shapes[i]))
    raw = model.invoice_headers(spark, sf).select(
        "id",
        F.concat(F.lit(" "), F.format_number("total_amount", 2)).alias("total_amount"),
        written.alias("invoice_date"),
        F.when(F.col("id") % 7 != 0, "EUR").alias("currency"),
        F.when(F.col("id") % 2 == 0, "n/a").otherwise("nan").alias("tax_amount"),
    )
    return cleaning.clean_headers(raw)


@query("clean_lines", f"""
    SELECT {model._KEY} AS id, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag || l_linestatus
           END AS item_name, l_quantity AS quantity, l_extendedprice AS total_price,
           CAST(0 AS DOUBLE) AS unit_price, 'line_item' AS row_type FROM lineitem""")
def clean_lines(spark, sf):
    raw = model.table(spark, sf, "lineitem").select(
        model.line_key().alias("id"),
        F.when(
            F.col("l_returnflag") != "A",
            F.concat(F.lit("  "), "l_returnflag", "l_linestatus", F.lit(" ")),
        ).alias("item_name"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.format_number("l_extendedprice", 2).alias("total_price"),
        F.lit(None).cast("string").alias("unit_price"),
        F.lit(None).cast("string").alias("row_type"),
    )
    return cleaning.clean_lines(raw)


@query("parse_dates", sql("SELECT id, invoice_date AS parsed FROM hdr", "hdr"))
def parse_dates(spark, sf):
    day, pick = F.col("invoice_date"), F.col("id") % 6
    shapes = ["yyyy-M-d", "dd/MM/yyyy", "d.M.yyyy", "d MMMM yyyy", "MMM d, yyyy", "'due' d MMM, yyyy"]
    written = F.when(pick == 0, F.date_format(day, shapes[0]))
    for i, shape in enumerate(shapes[1:], 1):
        written = written.when(pick == i, F.date_format(day, shape))
    return model.invoice_headers(spark, sf).select("id", dates.parse_date(written).alias("parsed"))


@query("detect_currency", """
    SELECT c_custkey AS id, (['EUR', 'GBP', 'AED', 'USD', 'USD', 'DZD'])[(c_custkey % 6 + 1)::INTEGER]
           AS currency, rnd(c_acctbal) AS amount FROM customer""".replace(
               "rnd(c_acctbal)", "c_acctbal"))
def detect_currency(spark, sf):
    amount = F.format_string("%.2f", "c_acctbal")
    labels = ["€ ", "£", "AED ", "UPDATE ", "$", "DA "]
    written = F.concat(F.element_at(F.array(*[F.lit(x) for x in labels]),
                                    (F.col("c_custkey") % 6 + 1).cast("int")), amount)
    return model.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), text.detect_currency(written).alias("currency"),
        numbers.parse_number(text.strip_currency(written)).alias("amount"),
    )


@query("hs_codes", """
    SELECT p_partkey AS id, CAST(84710000 + p_partkey % 10000 AS VARCHAR) AS hs_code,
           p_size % 2 = 0 AS is_code FROM part""")
def hs_codes(spark, sf):
    code = (F.lit(84710000) + F.col("p_partkey") % 10000).cast("string")
    dotted = F.concat_ws(".", F.substring(code, 1, 4), F.substring(code, 5, 2), F.substring(code, 7, 2))
    cell = F.when(F.col("p_size") % 2 == 0, dotted).otherwise(F.concat(F.lit("No. "), dotted))
    return model.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        text.extract_hs_code(F.concat(F.lit("HS "), dotted, F.lit(" pcs"))).alias("hs_code"),
        text.is_hs_code(cell).alias("is_code"),
    )


@query("ocr_noise", f"""
    SELECT doc_id, length(text) < 100
        OR length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(text) < 0.5
        OR regexp_matches(text, '[^\\p{{L}}\\p{{N}}_\\s]{{5,}}') AS noisy
    FROM documents""")
def ocr_noise(spark, sf):
    return model.table(spark, sf, "documents").select(
        "doc_id", text.has_ocr_noise(F.col("text")).alias("noisy")
    )


@query("highlight_terms", """
    SELECT item_id, regexp_replace(text, '(?i)(the|and)', '<em>\\1</em>', 'g') AS marked
    FROM benchmark""")
def highlight_terms(spark, sf):
    return model.table(spark, sf, "benchmark").select(
        "item_id", text.highlight(F.col("text"), ["and", "the"]).alias("marked")
    )


@query("decode_props", """
    SELECT event_type, count(*) AS events, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT
           AS k_sum FROM events GROUP BY 1""")
def decode_props(spark, sf):
    props = files.decode_json(F.col("props"), "map<string,string>")
    return model.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.try_element_at(props, F.lit("k")).cast("long")).alias("k_sum"),
    )


def invoice_pages(spark, sf):
    """Invoices written out as page text: a table, or numbered blocks for odd numbers."""
    part_no = F.element_at(F.split("id", "-"), 3).cast("long")
    lines = model.invoice_items_listed(spark, sf).withColumn("code", F.lit(10000000) + part_no)
    money = {c: F.format_number(c, 2) for c in ("unit_price", "total_price")}
    row = F.concat(
        F.rpad("item_name", 40, " "), F.lpad(F.format_string("%.0f", "quantity"), 10, " "),
        F.lpad(money["unit_price"], 14, " "), F.lpad(money["total_price"], 16, " "),
    )
    nested = fan_out(lines, "invoice_id").groupBy(F.col("invoice_id").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct(
            "line_number", "id", row.alias("row"), "item_name", "code",
            F.format_string("%.0f", "quantity").alias("qty"), money["unit_price"].alias("price"),
            money["total_price"].alias("total"),
        ))).alias("l")
    )
    block = F.transform(
        "l",
        lambda x, i: F.concat(
            (i + 1).cast("string"), F.lit(". "), x["item_name"], F.lit("\n"), x["code"],
            F.lit(" PCS "), x["qty"], F.lit("  "), x["price"], F.lit("  "), x["total"],
        ),
    )
    head = F.concat(
        F.lit("INVOICE\nInvoice No: INV-"), "doc_id", F.lit("\nSeller: Company "),
        F.col("doc_id") % 5, F.lit("\n\n"),
    )
    title = F.concat(
        F.rpad(F.lit("Description"), 40, " "), F.lpad(F.lit("Qty"), 10, " "),
        F.lpad(F.lit("Price"), 14, " "), F.lpad(F.lit("Amount"), 16, " "), F.lit("\n"),
    )
    foot = F.lit("\nGrand Total: 1.00\nBank details: see contract\nRemittance 12  34  56")
    vertical = (F.col("doc_id") % 2 == 1) & (F.size("l") >= 3)
    body = F.when(vertical, F.array_join(block, "\n")).otherwise(
        F.concat(title, F.array_join(F.col("l.row"), "\n"))
    )
    return nested.select("doc_id", F.concat(head, body, foot).alias("text"))


_EXPECTED_ITEMS = """
    expected AS (
        SELECT invoice_id AS doc_id, CAST(row_number() OVER w AS INTEGER) AS line_number,
               item_name, quantity, unit_price, total_price,
               invoice_id % 2 = 1 AND count(*) OVER (PARTITION BY invoice_id) >= 3 AS vertical,
               CAST(10000000 + split_part(id, '-', 3)::BIGINT AS VARCHAR) AS code
        FROM listed WINDOW w AS (PARTITION BY invoice_id ORDER BY line_number, id))"""


@query("extract_line_items", sql("""
    SELECT doc_id, line_number, item_name, quantity, unit_price, total_price, CASE WHEN vertical THEN code END AS hs_code, CASE WHEN vertical THEN 'PCS' END AS unit,
           CASE WHEN vertical THEN 'vertical' ELSE 'table' END AS layout
    FROM expected""", "listed", extra=_EXPECTED_ITEMS))
def extract_line_items(spark, sf):
    return extraction.extract_line_items(invoice_pages(spark, sf)).drop("description")


TEMPLATES = [
    templates.Template(
        f"t{i}", f"company-{i}",
        [r"^invoice$", rf"seller:\s*company {i}$", r"qty\s+price"],
        {"invoice_no": r"Invoice No:\s*(\S+)", "seller_name": r"^Seller:\s*(.+)$",
         "total_amount": r"Grand Total:\s*([\d.,]+)"},
        r"^(?P<description>\S[^\n]*?)\s{2,}(?P<quantity>\d+)\s{2,}(?P<unit_price>[\d.,]+)\s{2,}"
        r"(?P<total_price>[\d.,]+)$",
    )
    for i in range(4)
]


@query("match_templates", sql("""
    SELECT DISTINCT doc_id, 't' || doc_id % 5 AS template_id, 'company-' || doc_id % 5
           AS company_key, 'INV-' || doc_id AS invoice_no, 'Company ' || doc_id % 5 AS seller_name,
           CAST(1 AS DOUBLE) AS total_amount
    FROM expected WHERE doc_id % 5 < 4 AND NOT vertical""", "listed", extra=_EXPECTED_ITEMS))
def match_templates(spark, sf):
    matched = templates.match_templates(invoice_pages(spark, sf), TEMPLATES)
    return templates.template_fields(matched, TEMPLATES).select(
        "doc_id", "template_id", "company_key", "invoice_no", "seller_name", "total_amount"
    )


@query("match_template_rows", sql("""
    SELECT DISTINCT doc_id, 't' || doc_id % 5 AS template_id, 'company-' || doc_id % 5 AS company_key,
           CAST(1 AS DOUBLE) AS confidence
    FROM expected WHERE doc_id % 5 < 4 AND NOT vertical""", "listed", extra=_EXPECTED_ITEMS))
def match_template_rows(spark, sf):
    """The same detection with the templates as a table, among one that no document fits per customer."""
    known = spark.createDataFrame([(t.template_id, t.company_key, t.detection_patterns) for t in TEMPLATES],
                                  "template_id string, company_key string, detection_patterns array<string>")
    others = model.table(spark, sf, "customer").select(
        F.concat(F.lit("x"), "c_custkey").alias("template_id"), F.col("c_name").alias("company_key"),
        F.array(F.lit("^invoice$"), F.concat(F.lit("seller:\\s*"), "c_name", F.lit("$")),
                F.concat(F.lit("buyer:\\s*"), "c_name"), F.lit("qty\\s+price")).alias("detection_patterns"))
    return templates.match_template_table(invoice_pages(spark, sf), known.unionByName(others))


@query("template_items", sql("""
    SELECT doc_id, line_number, item_name, quantity, unit_price, total_price
    FROM expected WHERE doc_id % 5 < 4 AND NOT vertical""", "listed", extra=_EXPECTED_ITEMS))
def template_items(spark, sf):
    matched = templates.match_templates(invoice_pages(spark, sf), TEMPLATES)
    return templates.template_items(matched, TEMPLATES).select(
        "doc_id", "line_number", "item_name", "quantity", "unit_price", "total_price"
    )


@query("best_parse", """
    WITH a AS (SELECT l_orderkey AS doc_id, 'p' || l_linenumber AS parser,
                      l_linenumber * 10 AS priority, l_discount * 8 AS confidence,
                      l_quantity AS items FROM lineitem),
    u AS (SELECT doc_id, parser, priority, max(confidence) AS confidence FROM a GROUP BY 1, 2, 3)
    SELECT doc_id, parser, floor(confidence * 10000 + 0.50037) / 10000 AS confidence,
           confidence < 0.5 AS below_threshold
    FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence >= 0.5 DESC,
        CASE WHEN confidence >= 0.5 THEN -priority ELSE 0 END, confidence DESC, priority DESC) = 1""")
def best_parse(spark, sf):
    attempts = (
        model.table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("doc_id"),
            F.concat(F.lit("p"), "l_linenumber").alias("parser"),
            (F.col("l_linenumber") * 10).alias("priority"),
        )
        .agg(F.max(F.col("l_discount") * 8).alias("confidence"))
    )
    best = extraction.best_parse(attempts, threshold=0.5)
    return best.select(
        "doc_id", "parser", model.rounded("confidence").alias("confidence"), "below_threshold"
    )


@query("parse_chain", sql("""
    SELECT doc_id, CASE WHEN doc_id % 5 < 4 AND NOT vertical THEN 'template' ELSE 'table_aware' END
           AS parser, count(*) AS items FROM expected GROUP BY 1, 2""",
    "listed", extra=_EXPECTED_ITEMS))
def parse_chain(spark, sf):
    pages = invoice_pages(spark, sf)
    matched = templates.match_templates(pages, TEMPLATES)
    by_template = (
        templates.template_items(matched, TEMPLATES)
        .groupBy("doc_id", "confidence")
        .agg(F.count(F.lit(1)).alias("items"))
        .withColumns({"parser": F.lit("template"), "priority": F.lit(100)})
    )
    by_table = extraction.parse_attempts(
        extraction.extract_line_items(pages), "table_aware", 80
    )
    best = extraction.best_parse(by_template.unionByName(by_table.select(*by_template.columns)))
    return best.select("doc_id", "parser", "items")


@query("line_classes", sql("""
    SELECT doc_id, 1::BIGINT AS bank_lines, 1::BIGINT AS total_lines FROM expected GROUP BY 1""",
    "listed", extra=_EXPECTED_ITEMS).replace("1::BIGINT AS bank_lines", "2::BIGINT AS bank_lines"))
def line_classes(spark, sf):
    lines = invoice_pages(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count_if(text.is_bank_line(F.col("line"))).alias("bank_lines"),
        F.count_if(
            text.is_summary_line(F.col("line")) & F.contains(F.lower("line"), F.lit("grand"))
        ).alias("total_lines"),
    )


@query("product_pages", """
    SELECT page_id, url, nullif(trim(replace(replace(replace(regexp_extract(html,
        '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '')
        AS title, 'unknown' AS origin_confidence
    FROM pages""")
def product_pages(spark, sf):
    found = products.extract_products(spread(model.table(spark, sf, "pages")))
    return found.select("page_id", "url", "title", "origin_confidence")


def shop_pages(spark, sf):
    """Parts written out as shop pages in several layouts."""
    size = F.col("p_size")

    def piece(condition, *parts):
        return F.when(condition, F.concat(*[
            F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts
        ])).otherwise("")

    ld = piece(size % 3 == 0, '=<script type="application/ld+json">{"@type": "Product", "name": "',
               "p_name", '=", "brand": {"name": "', "p_brand", '="}, "description": "A ', "p_type",
               '= part", "category": "', "p_type", '="}</script>')
    elements = piece(size % 3 == 1, '=<span id="productTitle"> ', "p_name",
                     '= </span><a id="bylineInfo">Visit the ', "p_brand",
                     '= Store</a><div id="feature-bullets"><ul><li><span class="a-list-item">Size ',
                     "p_size", '=</span></li><li><span class="a-list-item">Type &amp; make ', "p_type",
                     "=</span></li></ul></div>")
    details = piece(size % 4 == 0, '=<table id="productDetails_techSpec_section_1"><tr><th>Country of '
                    "Origin</th><td>Germany</td></tr><tr><th> Item Weight </th><td>", "p_size",
                    "= kg</td></tr></table>")
    made = piece(size % 4 == 1, "=<p>Made in Japan.</p>")
    price = piece(F.lit(True), '=<div class="a-price"><span class="a-price-symbol">AED</span>'
                  '<span class="a-price-whole">', "p_size",
                  '=<span class="a-price-decimal">.</span></span><span class="a-price-fraction">'
                  '50</span></div><span data-hook="rating-out-of-text">4.2 out of 5</span>'
                  '<span id="acrCustomerReviewText">1,', "_three", "= ratings</span>")
    part = model.table(spark, sf, "part").withColumn(
        "_three", F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    )
    html = F.concat(
        F.lit("<html><head><title>"), "p_name", F.lit(" - Amazon.ae: shop</title>"), ld,
        F.lit("</head><body>"), elements, details, made, price, F.lit("</body></html>"),
    )
    host = F.when(size % 5 == 0, "shop.example.com").otherwise("www.amazon.ae")
    return part.select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("https://"), host, F.lit("/dp/B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
        .alias("url"),
        html.alias("html"),
    )


@query("extract_products", """
    SELECT p_partkey AS seq, p_name AS title, CASE WHEN p_size % 3 < 2 THEN p_brand END AS brand,
           CASE p_size % 3 WHEN 0 THEN 'A ' || p_type || ' part'
                WHEN 1 THEN 'Size ' || p_size || '; Type & make ' || p_type END AS description,
           CASE WHEN p_size % 3 = 0 THEN p_type END AS category,
           CASE p_size % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Japan' END AS origin_country,
           CASE p_size % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'unknown' END
               AS origin_confidence,
           CASE p_size % 4 WHEN 0 THEN 'Product detail table: Country of Origin = Germany'
                WHEN 1 THEN 'Pattern match: ''Made in Japan''' END AS evidence_text,
           'B' || lpad(p_partkey::VARCHAR, 9, '0') AS asin,
           CASE WHEN p_size % 4 = 0 THEN p_size || ' kg' END AS weight,
           'AED' || p_size || '.50' AS price, CAST(4.2 AS DOUBLE) AS rating,
           CAST(1000 + p_partkey % 1000 AS INTEGER) AS num_ratings,
           CASE WHEN p_size % 3 < 2 THEN p_brand ELSE '' END AS synonyms
    FROM part""")
def extract_products(spark, sf):
    found = products.extract_products(spread(shop_pages(spark, sf)))
    return found.select(
        "seq", "title", "brand", "description", "category", "origin_country", "origin_confidence",
        "evidence_text", "asin", "weight", "price", "rating", "num_ratings",
        F.coalesce(F.array_join("suggested_synonyms", "|"), F.lit("")).alias("synonyms"),
    )


@query("product_ingest_status", """
    SELECT CASE WHEN p_size % 5 = 0 THEN 'unsupported url' ELSE 'succeeded' END AS status,
           count(*) AS pages FROM part GROUP BY 1""")
def product_ingest_status(spark, sf):
    pages = spread(shop_pages(spark, sf))
    status = products.ingest_status(pages, products.extract_products(pages))
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def search_responses(spark, sf):
    """One response per order with its lines as results."""
    line = model.table(spark, sf, "lineitem")
    part = model.table(spark, sf, "part")
    entry = F.struct(
        F.when(F.col("l_linenumber") != 3, model.line_key()).alias("asin"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.when(
            F.col("l_returnflag") == "R",
            F.to_json(F.struct(F.format_string("AED %.2f", "l_extendedprice").alias("raw"),
                               F.col("l_extendedprice").alias("value"))),
        ).otherwise(F.format_number("l_extendedprice", 2)).alias("price"),
        F.col("p_size").alias("reviews"),
    )
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .groupBy(F.col("l_orderkey").alias("response_id"))
        .agg(F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("organic_results"))).alias("response"))
    )


@query("search_responses", f"""
    SELECT response_id, asin, title, price_value, reviews, product_url FROM (
        SELECT l_orderkey AS response_id, CASE WHEN l_linenumber <> 3 THEN {model._KEY} END AS asin,
               p_name AS title, l_extendedprice AS price_value, p_size::BIGINT AS reviews,
               'https://www.amazon.ae/dp/' || {model._KEY} AS product_url,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY
                   CASE WHEN l_linenumber <> 3 THEN {model._KEY} END NULLS FIRST, p_name, p_brand,
                   CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END, l_extendedprice) AS rn
        FROM lineitem JOIN part ON l_partkey = p_partkey)
    WHERE asin IS NOT NULL""")
def parsed_responses(spark, sf):
    found = products.parse_search_responses(search_responses(spark, sf))
    return found.select("response_id", "asin", "title", "price_value", "reviews", "product_url")


@query("category_codes", """
    SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'computers' WHEN 1 THEN 'tools'
           ELSE 'aps' END AS code FROM customer""")
def category_codes(spark, sf):
    pairs = [("Electronics", "Computers"), ("Industrial", "Tools"), ("Beauty", "None"), ("X", "all")]
    pick = F.col("c_nationkey") % 4

    def chosen(position):
        out = F.when(pick == 0, pairs[0][position])
        for i in (1, 2, 3):
            out = out.when(pick == i, pairs[i][position])
        return out

    return model.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), products.category_code(chosen(0), chosen(1)).alias("code")
    )


@query("supported_urls", """
    SELECT p_partkey AS id, p_size % 5 <> 0 AS supported FROM part""")
def supported_urls(spark, sf):
    return shop_pages(spark, sf).select(
        F.col("seq").alias("id"), products.supports_url(F.col("url")).alias("supported")
    )


@query("catalog_export", sql("""
    SELECT name, '' AS category, '' AS brand, hs_code, '' AS origin_country, '' AS unit FROM mat""",
    "mat"))
def catalog_export(spark, sf):
    return files.catalog_export(model.materials(spark, sf))


def template_register(spark, sf):
    return model.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("template_type"), (F.col("p_size") % 17 == 0).alias("is_default"),
        (F.col("p_size") % 3 > 0).alias("is_active"), F.col("p_size").alias("created_at"),
        F.col("p_retailprice").alias("updated_at"),
    )


_REGISTER = """
    reg AS (SELECT p_partkey AS id, p_name AS name, p_type AS template_type,
            p_size % 17 = 0 AS is_default, p_size % 3 > 0 AS is_active, p_size AS created_at,
            p_retailprice AS updated_at FROM part)"""


@query("default_templates", sql("""
    SELECT template_type, id, name FROM reg WHERE is_active
    QUALIFY row_number() OVER (PARTITION BY template_type
        ORDER BY is_default DESC, created_at DESC, id DESC) = 1""", extra=_REGISTER))
def default_templates(spark, sf):
    return templates.default_templates(template_register(spark, sf)).select(
        "template_type", "id", "name"
    )


@query("single_default", sql("""
    SELECT id, template_type, is_default AND row_number() OVER (PARTITION BY template_type, is_default
           ORDER BY updated_at DESC, id DESC) = 1 AS is_default FROM reg""", extra=_REGISTER))
def single_default(spark, sf):
    return templates.single_default(template_register(spark, sf)).select(
        "id", "template_type", "is_default"
    )


@query("template_list", sql("""
    SELECT id, name, is_default FROM reg WHERE template_type = 'PROMO' AND is_active""",
    extra=_REGISTER))
def template_list(spark, sf):
    return templates.list_templates(template_register(spark, sf), "PROMO").select(
        "id", "name", "is_default"
    )


@query("generated_documents", sql("""
    SELECT id, template_type AS document_type FROM reg WHERE template_type = 'SMALL'
    ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 20""", extra=_REGISTER))
def generated_documents(spark, sf):
    register = template_register(spark, sf).withColumnRenamed("template_type", "document_type")
    return files.generated_documents(register, "SMALL", 40, 20).select("id", "document_type")
