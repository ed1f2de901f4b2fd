"""Audit rules, verdicts and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import audit, history
from tallyweave.plans import model
from tallyweave.plans.model import AS_OF, sql
from tallyweave.plans.price_queries import PICK_EXACT, history_of
from tallyweave.plans.registry import query

_HEADER_RULES = f"""
    sums AS (SELECT invoice_id, sum(total_price) AS line_sum, count(*) AS n FROM items GROUP BY 1),
    h AS (SELECT inv.*, sums.line_sum, sums.n FROM inv LEFT JOIN sums ON sums.invoice_id = inv.id),
    header_issues AS (
        SELECT id AS invoice_id, 'MISSING_REQUIRED_FIELD' AS code, 'error' AS severity,
               'invoice_no' AS field FROM h WHERE coalesce(invoice_no, '') = ''
        UNION ALL SELECT id, 'MISSING_REQUIRED_FIELD', 'error', 'seller_name' FROM h
            WHERE coalesce(seller_name, '') = ''
        UNION ALL SELECT id, 'MISSING_REQUIRED_FIELD', 'error', 'invoice_date' FROM h
            WHERE invoice_date IS NULL
        UNION ALL SELECT id, 'NO_LINE_ITEMS', 'error', 'items' FROM h WHERE n IS NULL
        UNION ALL SELECT id, 'TOTAL_MISMATCH',
            CASE WHEN abs(total_amount - line_sum) > 1.0 THEN 'error' ELSE 'warning' END,
            'total_amount' FROM h WHERE total_amount <> 0 AND abs(total_amount - line_sum) > 0.02
        UNION ALL SELECT id, 'TAX_CALCULATION_ERROR', 'warning', 'tax_amount' FROM h
            WHERE tax_amount <> 0 AND subtotal <> 0 AND total_amount <> 0
              AND abs(total_amount - (subtotal + tax_amount)) > 0.02
        UNION ALL SELECT id, 'FUTURE_DATE', 'warning', 'invoice_date' FROM h
            WHERE invoice_date > DATE '{AS_OF}'
        UNION ALL SELECT id, 'OLD_DATE', 'warning', 'invoice_date' FROM h
            WHERE invoice_date < DATE '{AS_OF}' - 365
        UNION ALL SELECT id, 'DUE_BEFORE_INVOICE', 'error', 'due_date' FROM h
            WHERE due_date < invoice_date)"""

_LINE_RULES = """
    line_issues AS (
        SELECT invoice_id, id AS item_id, 'LINE_TOTAL_MISMATCH' AS code, 'error' AS severity
        FROM listed WHERE abs(total_price - round(quantity * unit_price, 2)) > 0.01
        UNION ALL SELECT invoice_id, id, 'NEGATIVE_QUANTITY', 'warning' FROM listed
            WHERE quantity < 0
        UNION ALL SELECT invoice_id, id, 'NEGATIVE_PRICE', 'warning' FROM listed
            WHERE unit_price < 0
        UNION ALL SELECT invoice_id, id, 'ZERO_QUANTITY', 'warning' FROM listed WHERE quantity = 0
        UNION ALL SELECT invoice_id, id, 'HIGH_UNIT_PRICE', 'warning' FROM listed
            WHERE unit_price > 1500
        UNION ALL SELECT invoice_id, id, 'MISSING_DESCRIPTION', 'warning' FROM listed
            WHERE length(trim(item_name)) < 3)"""

_DUPLICATES = """
    duplicates AS (
        SELECT invoice_id, id AS item_id, line_number, first_line
        FROM (SELECT *, row_number() OVER w AS rn, first_value(line_number) OVER w AS first_line
              FROM listed
              WINDOW w AS (PARTITION BY invoice_id, lower(trim(item_name)), unit_price
                           ORDER BY line_number, id))
        WHERE rn > 1)"""


def _headers(spark, sf, items=None):
    items = model.invoice_items(spark, sf) if items is None else items
    return audit.header_issues(model.invoices(spark, sf), items, model.as_of())


def _header_sql(codes: list[str]) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return sql(
        f"SELECT * FROM header_issues WHERE code IN ({listed})", "inv", "items", extra=_HEADER_RULES
    )


def _header_rule(codes: list[str]):
    def plan(spark, sf):
        found = audit.select_rules(_headers(spark, sf), codes)
        return found.select("invoice_id", "code", "severity", "field")

    return plan


for _name, _codes in {
    "audit_required": ["MISSING_REQUIRED_FIELD", "NO_LINE_ITEMS"],
    "audit_math": ["TOTAL_MISMATCH", "TAX_CALCULATION_ERROR"],
    "audit_dates": ["FUTURE_DATE", "OLD_DATE", "DUE_BEFORE_INVOICE"],
}.items():
    query(_name, _header_sql(_codes))(_header_rule(_codes))


@query("audit_lines", sql("SELECT * FROM line_issues", "listed", extra=_LINE_RULES))
def audit_lines(spark, sf):
    found = audit.line_issues(model.invoice_items_listed(spark, sf), max_unit_price=1500)
    return found.select("invoice_id", "item_id", "code", "severity")


@query("invoice_duplicates", sql("""
    SELECT invoice_id, item_id, line_number,
           'Possible duplicate: line ' || first_line || ' and ' || line_number AS message
    FROM duplicates""", "listed", extra=_DUPLICATES))
def invoice_duplicates(spark, sf):
    found = audit.duplicate_issues(model.invoice_items_listed(spark, sf))
    return found.select("invoice_id", "item_id", "line_number", "message")


_ALL_ISSUES = ",".join([_HEADER_RULES, _LINE_RULES, _DUPLICATES]) + """,
    prior AS (
        SELECT DISTINCT i.invoice_id, i.id
        FROM items i JOIN hdr v ON v.id = i.invoice_id
        JOIN hist h ON h.item_name_normalized = lower(trim(i.item_name))
            AND h.seller_name = i.seller_name
            AND h.invoice_date BETWEEN v.invoice_date - 30 AND v.invoice_date - 1),
    all_issues AS (
        SELECT invoice_id, code, severity FROM header_issues
        UNION ALL SELECT invoice_id, code, severity FROM line_issues
        UNION ALL SELECT invoice_id, 'POSSIBLE_DUPLICATE', 'warning' FROM duplicates
        UNION ALL SELECT invoice_id, 'CROSS_INVOICE_DUPLICATE', 'warning' FROM prior)"""


def _all_issues(spark, sf):
    lines = model.lines_with_parts(spark, sf, "l_orderkey")
    listed = model.invoice_items_listed(spark, sf, lines)
    items = model.invoice_items(spark, sf, lines)
    headers = model.invoice_headers(spark, sf)
    parts = [
        _headers(spark, sf, items),
        audit.line_issues(listed, max_unit_price=1500),
        audit.duplicate_issues(listed),
        audit.repeat_purchase_issues(items, headers, history_of(spark, sf, items)),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@query("audit_issue_counts", sql("""
    SELECT code, severity, count(*) AS issues, count(DISTINCT invoice_id) AS invoices
    FROM all_issues GROUP BY 1, 2""", "inv", "items", "listed", "hist", extra=_ALL_ISSUES))
def audit_issue_counts(spark, sf):
    return _all_issues(spark, sf).groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("issues"), F.count_distinct("invoice_id").alias("invoices")
    )


_ROLLUP = """
    SELECT v.id AS invoice_id, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count,
           coalesce(e, 0) = 0 AS passed,
           CASE WHEN coalesce(e, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
           rnd(greatest(0::DOUBLE, 1 - (coalesce(e, 0) * 0.15::DOUBLE
               + coalesce(w, 0) * 0.05::DOUBLE))) AS confidence
    FROM hdr v LEFT JOIN (
        SELECT invoice_id, count(*) FILTER (severity = 'error') AS e,
               count(*) FILTER (severity = 'warning') AS w
        FROM {issues} GROUP BY 1) c ON c.invoice_id = v.id"""


@query("audit_rollup", sql(_ROLLUP.format(issues="all_issues"), "inv", "items", "listed", "hist",
                           extra=_ALL_ISSUES))
def audit_rollup(spark, sf):
    rollup = audit.audit_rollup(model.invoice_headers(spark, sf), _all_issues(spark, sf))
    return rollup.withColumn("confidence", model.rounded("confidence"))


@query("audit_strict_rules", sql(
    _ROLLUP.format(issues="""(SELECT invoice_id, 'error' AS severity FROM all_issues
        WHERE code IN ('OLD_DATE', 'POSSIBLE_DUPLICATE'))"""),
    "inv", "items", "listed", "hist", extra=_ALL_ISSUES))
def audit_strict_rules(spark, sf):
    issues = audit.select_rules(
        _all_issues(spark, sf), ["OLD_DATE", "POSSIBLE_DUPLICATE"], strict=True
    )
    rollup = audit.audit_rollup(model.invoice_headers(spark, sf), issues)
    return rollup.withColumn("confidence", model.rounded("confidence"))


@query("audit_checks", sql("""
    SELECT check_type, passed, count(*) AS checks, sum(expected::DECIMAL(28, 2))::DOUBLE AS expected,
           sum(actual::DECIMAL(28, 2))::DOUBLE AS actual
    FROM (
        SELECT 'line_total' AS check_type, round(quantity * unit_price, 2) AS expected,
               total_price AS actual,
               abs(total_price - round(quantity * unit_price, 2)) <= 0.01 AS passed FROM listed
        UNION ALL SELECT 'invoice_total', line_sum, total_amount,
               abs(total_amount - line_sum) <= 0.02 FROM h2 WHERE total_amount <> 0 AND n > 0
        UNION ALL SELECT 'tax_total', subtotal + tax_amount, total_amount,
               abs(total_amount - (subtotal + tax_amount)) <= 0.02
               FROM h2 WHERE total_amount <> 0 AND tax_amount <> 0 AND subtotal <> 0)
    GROUP BY 1, 2""", "inv", "listed", extra="""
    h2 AS (SELECT inv.*, s.line_sum, s.n FROM inv LEFT JOIN (
        SELECT invoice_id, sum(total_price) AS line_sum, count(*) AS n FROM listed GROUP BY 1) s
        ON s.invoice_id = inv.id)"""))
def audit_checks(spark, sf):
    checks = audit.arithmetic_checks(
        model.invoices(spark, sf), model.invoice_items_listed(spark, sf)
    )
    return checks.groupBy("check_type", "passed").agg(
        F.count(F.lit(1)).alias("checks"),
        F.sum(F.col("expected").cast("decimal(28,2)")).cast("double").alias("expected"),
        F.sum(F.col("actual").cast("decimal(28,2)")).cast("double").alias("actual"),
    )


@query("validate_invoices", sql("""
    SELECT invoice_id, line_number, warning FROM (
        SELECT id AS invoice_id, NULL::INTEGER AS line_number, 'Missing seller name' AS warning
            FROM inv WHERE coalesce(seller_name, '') = ''
        UNION ALL SELECT id, NULL, 'No line items found' FROM inv
            WHERE id NOT IN (SELECT invoice_id FROM listed)
        UNION ALL SELECT inv.id, NULL, 'Total mismatch' FROM inv JOIN (
            SELECT invoice_id, sum(total_price) AS line_sum FROM listed GROUP BY 1) s
            ON s.invoice_id = inv.id
            WHERE total_amount <> 0 AND abs(total_amount - line_sum) > 0.02
        UNION ALL SELECT invoice_id, line_number, 'Line total mismatch' FROM listed
            WHERE abs(total_price - round(quantity * unit_price, 2)) > 0.01)""",
    "inv", "listed"))
def validate_invoices(spark, sf):
    warnings = audit.validation_warnings(
        model.invoices(spark, sf), model.invoice_items_listed(spark, sf)
    )
    short = (
        F.when(F.col("warning").rlike("^Line .*: Total mismatch"), "Line total mismatch")
        .when(F.col("warning").startswith("Total mismatch"), "Total mismatch")
        .otherwise(F.col("warning"))
    )
    return warnings.withColumn("warning", short)


def audit_runs(spark, sf):
    """Audit rows derived from the order lines: several runs per invoice."""
    return model.table(spark, sf, "lineitem").select(
        model.line_key().alias("id"),
        F.col("l_orderkey").alias("invoice_id"),
        F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("status"),
        F.col("l_shipdate").cast("date").alias("created_at"),
        F.col("l_discount").alias("confidence"),
    )


AUDIT_RUNS = f"""
    runs AS (SELECT {model._KEY} AS id, l_orderkey AS invoice_id,
             CASE WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'PASS' END AS status,
             CAST(l_shipdate AS DATE) AS created_at, l_discount AS confidence FROM lineitem)"""


@query("latest_audit", sql("""
    SELECT invoice_id, id, status, created_at, confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id
              ORDER BY created_at DESC, id DESC) AS rn FROM runs)
    WHERE rn = 1""", extra=AUDIT_RUNS))
def latest_audit(spark, sf):
    return audit.latest_audit(audit_runs(spark, sf))


_ANOMALIES = PICK_EXACT + """,
    anomalies AS (
        SELECT i.*, p.occurrence_count, p.min_price, p.max_price, p.avg_price,
               abs(i.unit_price - p.avg_price) / p.avg_price AS deviation,
               CASE WHEN i.unit_price > p.avg_price THEN 'above' ELSE 'below' END AS direction
        FROM items i JOIN picked p ON p.name = lower(trim(i.item_name)) AND p.seller = i.seller_name
        WHERE i.unit_price > 0 AND p.occurrence_count >= 2 AND p.avg_price > 0
          AND abs(i.unit_price - p.avg_price) / p.avg_price > 0.20)"""


def _cents(value: str) -> str:
    """Two decimals, half a cent upwards, of a value without the last bits of its sum."""
    return f"CAST(CAST(round({value}, 6) AS VARCHAR) AS DECIMAL(18, 2))"


@query("price_anomaly_issues", sql(f"""
    SELECT invoice_id, id AS item_id, line_number, 'PRICE_ANOMALY' AS code, 'warning' AS severity,
           printf('Line %d ''%s'': unit price %s is %s%% %s historical average %s (range %s–%s, %d records)',
                  line_number, item_name, {_cents('unit_price')}::VARCHAR,
                  CAST(CAST(round(deviation * 100, 6) AS VARCHAR) AS DECIMAL(18, 1))::VARCHAR, direction,
                  {_cents('avg_price')}::VARCHAR, {_cents('min_price')}::VARCHAR, {_cents('max_price')}::VARCHAR,
                  occurrence_count) AS message
    FROM anomalies""", "items", "stats", extra=_ANOMALIES))
def price_anomaly_issues(spark, sf):
    items = model.invoice_items(spark, sf, model.lines_with_parts(spark, sf))
    stats = history.price_stats(history_of(spark, sf, items))
    found = audit.price_anomaly_issues(items, stats)
    return found.select("invoice_id", "item_id", "line_number", "code", "severity", "message")


_FULL = ("""
    listed AS (SELECT * FROM items),""" + _ALL_ISSUES.replace("unit_price > 1500", "unit_price > 1000000")
         + "," + _ANOMALIES + """,
    every_issue AS (SELECT * FROM all_issues
                    UNION ALL SELECT invoice_id, 'PRICE_ANOMALY', 'warning' FROM anomalies)""")


@query("full_audit", sql("""
    SELECT invoice_id, code, severity, count(*) AS issues FROM every_issue GROUP BY 1, 2, 3""",
    "inv", "items", "hist", "stats", extra=_FULL))
def full_audit(spark, sf):
    """Every rule over every invoice as one issue table, counted by invoice and rule."""
    items = model.invoice_items(spark, sf, model.lines_with_parts(spark, sf, "l_orderkey"))
    past = history_of(spark, sf, items)
    issues = audit.audit_issues(
        model.invoices(spark, sf), items, model.as_of(), past, history.price_stats(past)
    )
    return issues.groupBy("invoice_id", "code", "severity").agg(F.count(F.lit(1)).alias("issues"))
