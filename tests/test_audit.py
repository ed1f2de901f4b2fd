from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.operators import audit, history, insights, rollups

LINES = (
    "id long, invoice_id long, line_number int, item_name string, hs_code string, seller_name string,"
    "quantity double, unit_price double, total_price double, row_type string"
)
HEADERS = (
    "id long, invoice_no string, seller_name string, invoice_date string, due_date string,"
    "currency string, total_amount double, subtotal double, tax_amount double"
)


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


def headers(spark, rows):
    df = spark.createDataFrame(rows, HEADERS)
    return df.withColumns({c: F.to_date(c) for c in ("invoice_date", "due_date")})


def line(i, inv=1, n=1, name="Widget", qty=1.0, price=10.0, total=None, kind="line_item", seller="ACME"):
    return (i, inv, n, name, None, seller, qty, price, qty * price if total is None else total, kind)


def today():
    return F.lit("2024-07-01").cast("date")


def test_line_rules(spark):
    rows = [
        line(1), line(2, name="ab"), line(3, qty=-1.0), line(4, price=-2.0), line(5, qty=0.0),
        line(6, price=2_000_000.0), line(7, total=10.02), line(8, total=10.005), line(9, name=None),
    ]
    got = {(r.item_id, r.code, r.severity) for r in audit.line_issues(lines(spark, rows)).collect()}
    assert got == {
        (2, "MISSING_DESCRIPTION", "warning"), (3, "NEGATIVE_QUANTITY", "warning"),
        (4, "NEGATIVE_PRICE", "warning"), (5, "ZERO_QUANTITY", "warning"),
        (6, "HIGH_UNIT_PRICE", "warning"), (7, "LINE_TOTAL_MISMATCH", "error"),
        (9, "MISSING_DESCRIPTION", "warning"),
    }


def test_header_rules(spark):
    heads = headers(spark, [
        (1, "A", "S", "2024-06-01", "2024-06-30", "USD", 20.0, 18.0, 2.0),
        (2, "", None, None, None, "USD", 0.0, 0.0, 0.0),
        (3, "C", "S", "2024-08-01", "2024-07-01", "USD", 20.5, 18.0, 2.0),
        (4, "D", "S", "2023-01-01", None, "USD", 25.0, 0.0, 0.0),
    ])
    rows = [line(1, 1, qty=2.0), line(2, 3, qty=2.0), line(3, 4, qty=2.0, kind="summary")]
    got = {
        (r.invoice_id, r.code, r.severity, r.field)
        for r in audit.header_issues(heads, lines(spark, rows), today()).collect()
    }
    assert got == {
        (2, "MISSING_REQUIRED_FIELD", "error", "invoice_no"),
        (2, "MISSING_REQUIRED_FIELD", "error", "seller_name"),
        (2, "MISSING_REQUIRED_FIELD", "error", "invoice_date"),
        (2, "NO_LINE_ITEMS", "error", "items"),
        (3, "TOTAL_MISMATCH", "warning", "total_amount"),
        (3, "TAX_CALCULATION_ERROR", "warning", "tax_amount"),
        (3, "FUTURE_DATE", "warning", "invoice_date"),
        (3, "DUE_BEFORE_INVOICE", "error", "due_date"),
        (4, "TOTAL_MISMATCH", "error", "total_amount"),
        (4, "OLD_DATE", "warning", "invoice_date"),
    }


def test_duplicates_and_rollup(spark):
    rows = [line(1, n=1), line(2, n=2, name=" widget "), line(3, n=3), line(4, n=4, price=11.0),
            line(5, inv=2)]
    issues = audit.duplicate_issues(lines(spark, rows))
    assert {(r.item_id, r.message) for r in issues.collect()} == {
        (2, "Possible duplicate: line 1 and 2"), (3, "Possible duplicate: line 1 and 3"),
    }
    heads = headers(spark, [(i, "A", "S", None, None, "USD", 0.0, 0.0, 0.0) for i in (1, 2)])
    got = {r.invoice_id: (r.passed, round(r.confidence, 2)) for r in audit.audit_rollup(heads, issues).collect()}
    assert got == {1: (True, 0.9), 2: (True, 1.0)}
    strict = audit.select_rules(issues, ["POSSIBLE_DUPLICATE"], strict=True)
    got = {r.invoice_id: (r.status, round(r.confidence, 2)) for r in audit.audit_rollup(heads, strict).collect()}
    assert got == {1: ("FAIL", 0.7), 2: ("PASS", 1.0)}


def price_rows(spark):
    rows = [
        ("pvc cable 10mm", "8544.42", "ACME", 1, "2024-01-15", 100.0, 5.0, "USD"),
        ("pvc cable 10mm", "8544.42", "ACME", 2, "2024-06-15", 200.0, 5.5, "USD"),
        ("steel rod", "7214.10", "BetaCo", 1, "2024-01-15", 50.0, 3.0, "USD"),
    ]
    schema = ("item_name_normalized string, hs_code string, seller_name string, invoice_id long,"
              "invoice_date string, quantity double, unit_price double, currency string")
    return spark.createDataFrame(rows, schema).withColumn("invoice_date", F.to_date("invoice_date"))


def test_price_statistics(spark):
    hist = price_rows(spark)
    stats = {r.item_name_normalized: r for r in history.price_stats(hist).collect()}
    assert len(stats) == 2
    cable = stats["pvc cable 10mm"]
    assert (cable.occurrence_count, cable.min_price, cable.max_price, cable.price_trend) == (
        2, 5.0, 5.5, "moderate",
    )
    assert stats["steel rod"].price_trend == "stable"
    assert history.filter_history(hist, date_from="2024-03-01", date_to="2024-12-31").count() == 1
    assert history.filter_stats(hist, item_name="PVC Cable").count() == 1
    assert history.filter_stats(hist, seller="beta").count() == 1


def test_price_anomaly_lookup(spark):
    stats = history.price_stats(price_rows(spark))
    rows = [
        line(1, name="PVC cable 10mm ", price=8.0), line(2, name="PVC cable 10mm", price=6.0),
        line(3, name="pvc cable 10mm", price=8.0, seller="Other"), line(4, name="steel rod", price=9.0),
        line(5, name="cable", price=8.0), line(6, name="pvc cable 10mm", price=8.0, kind="summary"),
    ]
    exact = {r.item_id for r in audit.price_anomalies(lines(spark, rows), stats).collect()}
    assert exact == {1, 3}
    loose = {r.item_id for r in audit.price_anomalies(lines(spark, rows), stats, match="contains").collect()}
    assert loose == {1, 3, 5}
    message = audit.price_anomaly_issues(lines(spark, rows[:1]), stats).first().message
    assert message == (
        "Line 1 'PVC cable 10mm ': unit price 8.00 is 52.4% above historical average 5.25 "
        "(range 5.00–5.50, 2 records)"
    )


def test_repeat_purchases(spark):
    heads = headers(spark, [
        (i, "A", "ACME", d, None, "USD", 0.0, 0.0, 0.0)
        for i, d in ((1, "2024-01-01"), (2, "2024-01-31"), (3, "2024-02-01"), (4, None))
    ])
    rows = lines(spark, [
        line(1, 1), line(2, 2), line(3, 3), line(4, 3, name="widget "), line(5, 4),
        line(6, 3, seller=" "), line(7, 3, price=-1.0),
    ])
    hist = history.price_history(rows, heads.filter("id < 4"), today())
    got = {
        r.item_id: (r.prior_records, [str(d) for d in r.prior_dates])
        for r in audit.repeat_purchases(rows, heads, hist).collect()
    }
    assert got == {
        2: (1, ["2024-01-01"]), 3: (1, ["2024-01-31"]), 4: (1, ["2024-01-31"]),
        7: (1, ["2024-01-31"]),
    }


def test_findings(spark):
    df = spark.createDataFrame(
        [(1, 'x [{"issue": "odd", "severity": "error", "line": 2}, {"note": 1}] y'), (2, "none"), (3, "[bad")],
        "invoice_id long, response string",
    )
    got = audit.parse_findings(df).collect()
    assert [(r.invoice_id, r.severity, r.message, r.field) for r in got] == [(1, "error", "odd", "items[1]")]


def test_quality_scores(spark):
    heads = headers(spark, [(1, "A", "S", "2024-01-01", None, "USD", 20.0, 0.0, 0.0),
                            (2, None, None, None, None, "USD", 0.0, 0.0, 0.0)]).withColumn(
        "buyer_name", F.lit(None).cast("string"))
    rows = lines(spark, [line(1, qty=2.0), line(2, qty=0.0)])
    got = {r.invoice_id: round(r.quality_score, 3) for r in rollups.parse_quality(heads, rows).collect()}
    assert got == {1: 0.825, 2: 0.1}
    got = {r.invoice_id: round(r.extraction_score, 3) for r in rollups.extraction_quality(heads, rows).collect()}
    assert got == {1: 0.925, 2: 0.0}


def test_insights_and_reminders(spark):
    docs = spark.createDataFrame(
        [(1, "A", "2024-07-01"), (2, "B", "2024-07-31"), (3, "C", "2024-08-01"), (4, "D", None), (5, "E", "2024-07-08")],
        "id long, title string, expiry_date string",
    ).withColumn("expiry_date", F.to_date("expiry_date"))
    got = insights.expiry_insights(docs, today())
    assert {(r.linked_entity_id, r.severity) for r in got.collect()} == {
        ("1", "critical"), ("2", "warning"), ("5", "critical"),
    }
    reminders = spark.createDataFrame(
        [("company_document", 1, False), ("company_document", 2, True)],
        "linked_entity_type string, linked_entity_id long, is_done boolean",
    )
    assert {r.linked_entity_id for r in insights.new_reminders(got, reminders, today()).collect()} == {"2", "5"}
    open_items = lines(spark, [line(1, name=" Bolt"), line(2, name="bolt"), line(3, name=" ")])
    only = insights.unmatched_insights(open_items).collect()
    assert [(r.title, r.linked_entity_id) for r in only] == [("Unmatched item: bolt", "2")]


def test_row_per_name_carries_no_more_than_its_insight(spark):
    found = insights.unmatched_insights(lines(spark, [line(1, name="Bolt"), line(3, name="bolt")]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    picked = [text for text in plan.split("\n") if "max_by(struct(" in text]
    assert picked and not any("unit_price" in text for text in picked)
    assert [(r.title, r.linked_entity_id) for r in found.collect()] == [("Unmatched item: bolt", "3")]


def test_price_reference_of_seller_then_of_item(spark):
    schema = ("item_name_normalized string, hs_code string, seller_name string, currency string,"
              "occurrence_count long, min_price double, max_price double, avg_price double")
    stats = spark.createDataFrame([
        ("bolt", "a", "ACME", "USD", 2, 1.0, 1.0, 1.0), ("bolt", "b", "ACME", "USD", 2, 9.0, 9.0, 9.0),
        ("bolt", "a", "Beta", "USD", 3, 2.0, 2.0, 2.0), ("bolt", "a", None, "USD", 5, 4.0, 4.0, 4.0),
        ("rod", None, "Beta", "EUR", 2, 3.0, 3.0, 3.0), (None, "a", "ACME", "USD", 9, 7.0, 7.0, 7.0),
    ], schema)
    rows = lines(spark, [
        line(1, name=" Bolt"), line(2, name="bolt", seller="Beta"), line(3, name="bolt", seller=None),
        line(4, name="bolt", seller=""), line(5, name="bolt", seller="Other"), line(6, name="rod"),
        line(7, name="gear"), line(8, name=None), line(9, name="bolt", price=-1.0), line(1, name="bolt"),
    ])
    found = audit.with_price_reference(rows, stats)
    got = sorted((r.id, r.stat.avg_price) for r in found.collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 2.0), (3, 4.0), (4, 4.0), (5, 4.0), (6, 3.0)]


def test_repeat_purchases_on_all_days(spark):
    dates = spark.sql("SELECT explode(sequence(DATE'1969-08-01', DATE'1970-08-01', INTERVAL 3 DAYS)) AS d")
    dates = dates.withColumn("id", F.row_number().over(Window.orderBy("d")).cast("long"))
    heads = dates.select("id", F.col("d").alias("invoice_date"))
    few = heads.filter("id % 4 = 0 OR id > 100")
    rows = heads.select(
        "id", F.col("id").alias("invoice_id"), F.lit(1).alias("line_number"), F.lit("Bolt").alias("item_name"),
        F.lit("ACME").alias("seller_name"), F.lit("line_item").alias("row_type"),
    )
    past = few.select(F.lit("bolt").alias("item_name_normalized"), F.lit("ACME").alias("seller_name"), "invoice_date")
    past = past.unionByName(past.filter(F.dayofmonth("invoice_date") < 15)).unionByName(
        past.limit(1).withColumn("invoice_date", F.lit(None).cast("date")))
    days = [r.invoice_date for r in past.collect() if r.invoice_date]
    for window in (1, 7, 30):
        want = {}
        for r in heads.collect():
            before = [d for d in days if 1 <= (r.invoice_date - d).days <= window]
            if before:
                want[r.id] = (len(before), sorted(set(before)))
        found = audit.repeat_purchases(rows, heads, past, window)
        assert {r.item_id: (r.prior_records, r.prior_dates) for r in found.collect()} == want


def test_duplicates_by_name_and_price(spark):
    rows = lines(spark, [
        line(1, n=2), line(2, n=1), line(3, n=None), line(4, n=1, price=None, total=0.0), line(5, n=2, price=None, total=0.0),
        line(6, None, 1), line(7, None, 2), line(8, 2, 1, name=None), line(9, 2, 2, name=" "), line(10, 2, 3, price=-0.0),
        line(11, 2, 4, price=0.0), line(12, 3, 1), line(12, 3, 1), line(13, 3, 1),
    ])
    found = audit.duplicate_issues(rows)
    assert sorted((r.item_id, r.line_number) for r in found.collect()) == [(1, 2), (2, 1), (9, 2), (11, 4), (13, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("== Initial Plan ==")[0].count(" Exchange ") == 1


def test_price_reference_by_parts_of_names(spark):
    schema = ("item_name_normalized string, hs_code string, seller_name string, currency string,"
              "occurrence_count long, min_price double, max_price double, avg_price double")
    stats = spark.createDataFrame([
        ("hot bolt", "a", "ACME", "USD", 2, 1.0, 1.0, 1.0), ("bolt m4", None, "The Acme", "USD", 3, 2.0, 2.0, 2.0),
        ("bolt m4", "b", "acme", "USD", 3, 3.0, 3.0, 3.0), ("hot bolt", "a", None, "USD", 9, 4.0, 4.0, 4.0),
        ("rod", "a", "Beta", "EUR", 2, 5.0, 5.0, 5.0), (None, "a", "ACME", "USD", 9, 7.0, 7.0, 7.0),
    ], schema)
    rows = lines(spark, [
        line(1, name="Bolt"), line(2, name="hot bolt", seller="acme"), line(3, name="bolt", seller=None),
        line(4, name="bolt", seller="Other"), line(5, name="od", seller="BETA"), line(6, name="gear"),
        line(7, name="bolt", seller=""), line(1, name="Bolt"),
    ])
    found = audit.with_price_reference(rows, stats, match="contains")
    got = sorted((r.id, r.stat.avg_price) for r in found.collect())
    assert got == [(1, 2.0), (1, 2.0), (2, 1.0), (3, 4.0), (4, 4.0), (5, 5.0), (7, 4.0)]
