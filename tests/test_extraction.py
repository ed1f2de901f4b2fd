import json

from pyspark.sql import functions as F

from tallyweave.operators import cleaning, extraction, products, templates

TABLE = """ACME LLC
Invoice No: 77

Item                Qty     Price     Amount    HS Code
1. Steel pipe       5       200.00    1,000.00  8471.30.00
Copper wire         2       10,50     21,00     740819
Long text only
Sub Total           7       210.50    1,021.00
Plain rod           4                 100.00
Bank: somewhere     1       2         3
Grand Total  1,121.00
Beneficiary: ACME   1  2
"""
VERTICAL = """1. PVC cable
10mm grey
85444200 PCS 100 5.00 500.00
extra note
2 - Steel rod
72141000 KG 50 3.00 150.00
3. Valve
84818000 pcs 2 1,000.50 2,001.00
IBAN: DE89370400440532013000
"""


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_table_layout(spark):
    got = extraction.extract_line_items(docs(spark, [TABLE])).orderBy("line_number").collect()
    rows = [(r.item_name, r.quantity, r.unit_price, r.total_price, r.hs_code) for r in got]
    assert rows[0] == ("Steel pipe", 5.0, 200.0, 1000.0, "84713000")
    assert rows[1] == ("Copper wire", 2.0, 10.5, 21.0, "740819")
    assert [r.line_number for r in got] == list(range(1, len(got) + 1))
    assert all("Total" not in r.item_name and "Bank" not in r.item_name for r in got)
    assert {r.layout for r in got} == {"table"}


def test_vertical_layout(spark):
    got = extraction.extract_line_items(docs(spark, [VERTICAL])).orderBy("line_number").collect()
    assert [(r.line_number, r.item_name, r.hs_code, r.unit, r.quantity, r.unit_price, r.total_price) for r in got] == [
        (1, "PVC cable 10mm grey extra note", "85444200", "PCS", 100.0, 5.0, 500.0),
        (2, "Steel rod", "72141000", "KG", 50.0, 3.0, 150.0),
        (3, "Valve", "84818000", "pcs", 2.0, 1000.5, 2001.0),
    ]


def test_documents_without_table(spark):
    assert extraction.extract_line_items(docs(spark, ["", "just words", "1 2\n3 4"])).count() == 0


def test_likelihood(spark):
    got = docs(spark, [TABLE, "none"]).select(
        "doc_id", extraction.table_likelihood(F.col("text")).alias("v")).orderBy("doc_id").collect()
    assert [round(r.v, 2) for r in got] == [0.9, 0.0] or got[0].v > 0.7


def test_pages_are_joined_in_order(spark):
    pages = spark.createDataFrame(
        [(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, None)], "doc_id long, page_no int, text string")
    got = extraction.document_text(pages).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "--- Page 1 ---\na\n\n--- Page 2 ---\nb")]


def test_best_parse(spark):
    attempts = spark.createDataFrame(
        [(1, "t", 100, 0.7), (1, "a", 80, 0.75), (1, "v", 60, 0.9), (2, "t", 100, 0.5), (2, "a", 80, 0.6),
         (3, "t", 100, 0.6), (3, "a", 80, 0.6)],
        "doc_id long, parser string, priority int, confidence double")
    got = {r.doc_id: (r.parser, r.below_threshold) for r in extraction.best_parse(attempts).collect()}
    assert got == {1: ("a", False), 2: ("a", True), 3: ("t", True)}


def test_replies(spark):
    body = {"invoice_no": " X1 ", "invoice_date": "15/01/2024", "currency": "eur", "total_amount": "1,200.50",
            "items": [{"description": "1. Bolt", "quantity": "2"}, {"description": ""}, {"description": "Nut", "unit_price": 3}]}
    df = spark.createDataFrame(
        [(1, json.dumps(body)), (2, "Here:\n```json\n" + json.dumps(body) + "\n```"), (3, "no json")],
        "doc_id long, response string")
    got = {r.doc_id: r for r in extraction.parse_replies(df).collect()}
    for i in (1, 2):
        assert (got[i].invoice_no, str(got[i].invoice_date), got[i].currency, got[i].total_amount) == (
            "X1", "2024-01-15", "EUR", 1200.5)
        assert [(x.line_number, x.item_name, x.quantity, x.unit_price) for x in got[i]["items"]] == [
            (1, "Bolt", 2.0, 0.0), (3, "Nut", 0.0, 3.0)]
    assert not got[3].valid


def test_templates(spark):
    template = templates.Template(
        "t1", "acme", ["acme llc", "invoice no", "nothing here", "pipe"],
        {"invoice_no": r"invoice no:\s*(\w+)", "total_amount": r"grand total\s+([\d.,]+)"},
        r"^(?P<description>\w[\w ]+?)\s{2,}(?P<quantity>\d+)\s{2,}(?P<unit_price>[\d.,]+)\s{2,}(?P<total_price>[\d.,]+)")
    matched = templates.match_templates(docs(spark, [TABLE, "other"]), [template], 0.7)
    assert [(r.doc_id, r.confidence) for r in matched.collect()] == [(0, 0.75)]
    fields = templates.template_fields(matched, [template]).first()
    assert (fields.invoice_no, fields.total_amount, fields.seller_name) == ("77", 1121.0, None)
    items = templates.template_items(matched, [template]).collect()
    assert ("Copper wire", 2.0, 10.5, 21.0) in {(r.item_name, r.quantity, r.unit_price, r.total_price) for r in items}


def page(spark, html, url="https://www.amazon.ae/dp/B09V3KXJPB"):
    return products.extract_products(spark.createDataFrame([(url, html)], "url string, html string")).first()


def test_structured_data_wins(spark):
    ld = json.dumps([{"@type": "Other"}, {"@type": "Product", "name": "Drill X", "brand": {"name": "BOSCH"},
                      "description": "Good", "category": "Tools"}])
    got = page(spark, f'<script type="application/ld+json">{ld}</script><span id="productTitle">No</span>')
    assert (got.title, got.brand, got.description, got.category) == ("Drill X", "BOSCH", "Good", "Tools")
    assert got.asin == "B09V3KXJPB"
    plain = json.dumps({"@type": "Product", "name": "Y", "brand": "Acme"})
    assert page(spark, f'<script type="application/ld+json">{plain}</script>').brand == "Acme"


def test_page_elements(spark):
    html = (
        '<html><body><span id="productTitle"> DeWalt &amp; Saw </span><a id="bylineInfo">Visit the DeWalt Store</a>'
        '<div id="feature-bullets"><ul><li><span class="a-list-item">One</span></li>'
        '<li><span class="x a-list-item"> Two <b>x</b></span></li></ul></div>'
        '<table id="productDetails_techSpec_section_1"><tr><th>Country of Origin</th><td>China</td></tr>'
        '<tr><th>Item Weight</th><td>1 kg</td></tr><tr><th>Item Weight</th><td>2 kg</td></tr></table>'
        '<div id="wayfinding-breadcrumbs_feature_div"><a href="#">A</a><a href="#">Saws</a></div>'
        '<span class="a-price-symbol">$</span><span class="a-price-whole">1,299</span>'
        '<i class="a-icon a-star-4" title="4.5 out of 5 stars"></i>'
        '<span id="acrCustomerReviewText">1,234 ratings</span></body></html>')
    got = page(spark, html, "https://x.example.com/p")
    assert (got.title, got.brand, got.description, got.category) == ("DeWalt & Saw", "DeWalt", "One; Twox", "Saws")
    assert (got.origin_country, got.origin_confidence) == ("China", "confirmed")
    assert (got.weight, got.price, got.rating, got.num_ratings, got.asin) == ("2 kg", "$1,299.00", 4.5, 1234, None)
    assert got.suggested_synonyms == ["& Saw", "DeWalt"]
    assert page(spark, "<html><head></head></html>").title is None


def test_origin_in_text(spark):
    got = page(spark, "<title>T</title><p>Made in Germany</p><script>Made in Nowhere</script>")
    assert (got.origin_country, got.origin_confidence, got.evidence_text) == (
        "Germany", "likely", "Pattern match: 'Made in Germany'")


def test_urls_and_challenges(spark):
    df = spark.createDataFrame(
        [("https://www.amazon.ae/dp/B001", "x"), ("https://amazon.co.uk/dp/1", "Robot Check"),
         ("https://www.aliexpress.com/item/1", ""), ("not-a-url", ""), ("", "")], "url string, html string")
    got = df.select(products.supports_url(F.col("url")).alias("s"), products.is_challenge(F.col("html")).alias("c")).collect()
    assert [r.s for r in got] == [True, True, False, False, False]
    assert [r.c for r in got] == [False, True, False, False, False]


def test_search_responses(spark):
    data = {"organic_results": [
        {"asin": "A1", "title": "T", "price": {"value": 10.5, "currency": "USD"}, "reviews": 3},
        {"title": "no id"}, {"asin": "A2", "price": "AED 1,299.00", "link": "http://x"}, {"asin": "A3"}]}
    df = spark.createDataFrame([(1, json.dumps(data)), (2, "bad")], "id long, response string")
    got = products.parse_search_responses(df, limit=3).collect()
    assert [(r.asin, r.price, r.price_value, r.currency, r.product_url) for r in got] == [
        ("A1", "10.5", 10.5, "USD", "https://www.amazon.ae/dp/A1"), ("A2", "AED 1,299.00", 1299.0, "AED", "http://x")]


def test_compatibility_form(spark):
    df = spark.createDataFrame([("ﬁne ½",), ("plain",), (None,)], "t string")
    assert [r.t for r in cleaning.compatibility_form(df, "t").orderBy(F.col("t").desc_nulls_last()).collect()] == [
        "plain", "fine 1⁄2", None]


def test_templates_work_a_text_out_once(spark):
    made = docs(spark, [TABLE, "other"]).select("doc_id", F.concat(F.reverse(F.reverse("text")), F.lit("\n")).alias("text"))
    template = templates.Template("t", "acme", ["acme", r"invoice no:\s*\d+"],
                                  item_pattern=r"^(?P<description>\S[^\n]*?)\s{2,}(?P<quantity>\d+)\s{2,}")
    matched = templates.match_templates(made, [template])
    assert [(r.doc_id, r.template_id, r.confidence) for r in matched.collect()] == [(0, "t", 1.0)]
    items = templates.template_items(matched, [template])
    assert {(r.doc_id, r.confidence) for r in items.collect()} == {(0, 1.0)}
    for df in (matched, items):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1
