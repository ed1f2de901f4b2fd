"""Invoice audit: rules over headers and lines, price anomalies, repeat purchases.

The codes, categories and message texts of the rules are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.numbers import line_total, line_total_ok, relative_deviation
from tallyweave.functions.text import normalized_name, strip
from tallyweave.operators.contains import contains_pairs
from tallyweave.operators.history import STATS_KEYS
from tallyweave.operators.partitioning import shared, unfiltered

ISSUE_COLUMNS = [
    "invoice_id", "item_id", "line_number", "code", "severity", "category", "field", "message",
    "expected", "actual",
]


@dataclass(frozen=True)
class Rule:
    """One audit rule: when it fires and what the issue says."""

    condition: Column
    code: str
    severity: Column | str
    category: str
    field: Column | str
    message: Column | str
    expected: Column | None = None
    actual: Column | None = None


def _text(value: Column | str | None) -> Column:
    return F.lit(value).cast("string") if value is None or isinstance(value, str) else value.cast("string")


def _issues(df: DataFrame, keys: list[Column], rules: list[Rule]) -> DataFrame:
    """One row per rule that fires, in a single pass over `df`.

    Only the number of the rule is exploded. The texts are worked out behind that,
    so a plan that needs the codes alone never formats a message.
    """
    numbers = F.array(*[F.when(r.condition, F.lit(i)) for i, r in enumerate(rules)])
    fired = df.withColumn("_rule", F.explode(F.array_compact(numbers)))

    def of(name: str) -> Column:
        out = None
        for i, rule in enumerate(rules):
            test, value = F.col("_rule") == i, _text(getattr(rule, name))
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.alias(name)

    texts = ["code", "severity", "category", "field", "message", "expected", "actual"]
    return fired.select(*keys, *[of(name) for name in texts])


def _line_field(column: str) -> Column:
    return F.concat(F.lit("items["), F.col("line_number"), F.lit(f"].{column}"))


def _line_message(text: str | Column) -> Column:
    return F.concat(
        F.lit("Line "), F.col("line_number"), F.lit(text) if isinstance(text, str) else text
    )


def _blank(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def line_issues(lines: DataFrame, max_unit_price: float = 1_000_000) -> DataFrame:
    """Value rules and the line-total rule, one scan over the lines."""
    qty, price, total = F.col("quantity"), F.col("unit_price"), F.col("total_price")
    expected = line_total(qty, price)
    issues = [
        Rule(
            ~line_total_ok(qty, price, total), "LINE_TOTAL_MISMATCH", "error", "math_error",
            _line_field("total_price"),
            _line_message(F.concat(F.lit(" total mismatch: "), total, F.lit(" != "), expected)),
            expected, total,
        ),
        Rule(qty < 0, "NEGATIVE_QUANTITY", "warning", "value_error",
               _line_field("quantity"), _line_message(": Negative quantity")),
        Rule(price < 0, "NEGATIVE_PRICE", "warning", "value_error",
               _line_field("unit_price"), _line_message(": Negative unit price")),
        Rule(qty == 0, "ZERO_QUANTITY", "warning", "value_error",
               _line_field("quantity"), _line_message(": Zero quantity")),
        Rule(price > max_unit_price, "HIGH_UNIT_PRICE", "warning", "value_warning",
               _line_field("unit_price"),
               _line_message(F.concat(F.lit(": Unusually high unit price: "), price))),
        Rule(F.coalesce(F.length(strip(F.col("item_name"))) < 3, F.lit(True)),
               "MISSING_DESCRIPTION", "warning", "missing_field",
               _line_field("item_name"), _line_message(": Missing or too short description")),
    ]
    keys = [F.col("invoice_id"), F.col("id").alias("item_id"), F.col("line_number")]
    return _issues(lines, keys, issues)


def duplicate_issues(lines: DataFrame) -> DataFrame:
    """Later lines that repeat name and unit price of an earlier line of the invoice.

    Lines are dealt by key once, and the window that finds the first of a key puts
    what does not fit in memory on disk.
    """
    keyed = lines.filter(F.col("invoice_id").isNotNull() & F.col("unit_price").isNotNull()).select(
        "invoice_id",
        F.col("id").alias("item_id"),
        "line_number",
        F.lower(strip(F.coalesce("item_name", F.lit("")))).alias("_name"),
        F.col("unit_price").alias("_price"),
    )
    at = F.struct("line_number", "item_id")
    first = F.min(at).over(Window.partitionBy("invoice_id", "_name", "_price"))
    later = keyed.withColumn("_first", first).filter(at > F.col("_first"))
    message = F.concat(
        F.lit("Possible duplicate: line "), F.col("_first.line_number"), F.lit(" and "),
        F.col("line_number"),
    )
    field = F.concat(F.lit("items["), F.col("line_number"), F.lit("]"))
    return _issues(
        later,
        [F.col("invoice_id"), F.col("item_id"), F.col("line_number")],
        [Rule(F.lit(True), "POSSIBLE_DUPLICATE", "warning", "duplicate", field, message)],
    )


def with_line_sums(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with the sum over all lines and the line count (NULL without lines)."""
    sums = lines.groupBy(F.col("invoice_id").alias("id")).agg(
        F.sum("total_price").alias("_line_sum"), F.count(F.lit(1)).alias("_line_count")
    )
    return invoices.join(sums, "id", "left")


def _nonzero(c: Column) -> Column:
    return F.coalesce(c != 0.0, F.lit(False))


def header_issues(invoices: DataFrame, lines: DataFrame, as_of: Column) -> DataFrame:
    """Required fields, totals, tax and dates, one pass over the headers."""
    df = with_line_sums(invoices, lines)
    total, calculated = F.col("total_amount"), F.col("_line_sum")
    diff = F.abs(total - calculated)
    tax_diff = F.abs(total - (F.col("subtotal") + F.col("tax_amount")))
    date, due = F.col("invoice_date"), F.col("due_date")

    def missing(condition: Column, field: str, label: str) -> Rule:
        return Rule(condition, "MISSING_REQUIRED_FIELD", "error", "missing_field", field,
                      f"Missing required field: {label}")

    issues = [
        missing(_blank(F.col("invoice_no")), "invoice_no", "Invoice number"),
        missing(_blank(F.col("seller_name")), "seller_name", "Seller name"),
        missing(date.isNull(), "invoice_date", "Invoice date"),
        Rule(F.col("_line_count").isNull(), "NO_LINE_ITEMS", "error", "missing_field", "items",
               "No line items found"),
        Rule(
            _nonzero(total) & (diff > 0.02), "TOTAL_MISMATCH",
            F.when(diff > 1.0, "error").otherwise("warning"), "total_mismatch", "total_amount",
            F.concat(F.lit("Invoice total mismatch: declared "), total, F.lit(" != calculated "),
                     F.format_string("%.2f", calculated)),
            F.round(calculated, 2), total,
        ),
        Rule(
            _nonzero(F.col("tax_amount")) & _nonzero(F.col("subtotal")) & _nonzero(total)
            & (tax_diff > 0.02),
            "TAX_CALCULATION_ERROR", "warning", "tax_calculation", "tax_amount",
            "Total doesn't match subtotal + tax",
        ),
        Rule(date > as_of, "FUTURE_DATE", "warning", "date_error", "invoice_date",
               F.concat(F.lit("Invoice date is in the future: "), date)),
        Rule(date < F.date_sub(as_of, 365), "OLD_DATE", "warning", "date_warning",
               "invoice_date", F.concat(F.lit("Invoice date is over 1 year old: "), date)),
        Rule(due < date, "DUE_BEFORE_INVOICE", "error", "date_error", "due_date",
               "Due date is before invoice date"),
    ]
    keys = [
        F.col("id").alias("invoice_id"),
        F.lit(None).cast("string").alias("item_id"),
        F.lit(None).cast("int").alias("line_number"),
    ]
    return _issues(df, keys, issues)


def arithmetic_checks(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per comparison made by the sum rules, passed or not."""
    per_line = lines.select(
        "invoice_id",
        F.lit("line_total").alias("check_type"),
        line_total(F.col("quantity"), F.col("unit_price")).alias("expected"),
        F.col("total_price").alias("actual"),
        line_total_ok(F.col("quantity"), F.col("unit_price"), F.col("total_price")).alias("passed"),
    )
    total = F.col("total_amount")
    with_tax = F.col("subtotal") + F.col("tax_amount")

    def check(kind: str, condition: Column, expected: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(kind).alias("check_type"),
                expected.alias("expected"),
                total.alias("actual"),
                (F.abs(total - expected) <= 0.02).alias("passed"),
            ),
        )

    has_total = _nonzero(total)
    per_header = (
        with_line_sums(invoices, lines)
        .select(
            F.col("id").alias("invoice_id"),
            F.explode(
                F.array_compact(
                    F.array(
                        check("invoice_total", has_total & F.col("_line_count").isNotNull(),
                              F.col("_line_sum")),
                        check("tax_total",
                              has_total & _nonzero(F.col("tax_amount")) & _nonzero(F.col("subtotal")),
                              with_tax),
                    )
                )
            ).alias("_check"),
        )
        .select("invoice_id", "_check.*")
    )
    return per_line.unionByName(per_header)


def _lookup_contains(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """Best statistics per (name, seller), matched by substring on both.

    The substring match runs on distinct names and distinct sellers only, and statistics
    are cut to the best per wanted name and seller of theirs before sellers meet.
    """
    figures, order = ["occurrence_count", "min_price", "max_price", "avg_price"], [F.col(k) for k in STATS_KEYS]
    wanted, stats = shared(wanted), shared(stats.select(*STATS_KEYS, *figures))
    names = contains_pairs(
        wanted.select(F.col("_name").alias("needle")),
        stats.select(F.col("item_name_normalized").alias("haystack")),
    ).select(F.col("needle").alias("_name"), F.col("haystack").alias("item_name_normalized"))
    sellers = contains_pairs(
        wanted.select(F.lower("_seller").alias("needle")),
        stats.select(F.lower("seller_name").alias("haystack")),
    ).select(F.col("needle").alias("_seller_key"), F.col("haystack").alias("_stat_seller"))
    rank = F.struct(-F.col("occurrence_count"), *order)
    by_name = shared(
        names.join(stats, "item_name_normalized")
        .groupBy("_name", F.lower("seller_name").alias("_stat_seller"))
        .agg(F.min_by(F.struct(*figures), rank).alias("stat"), F.min(rank).alias("_rank"))
    )
    best = F.min_by("stat", "_rank")
    pair = (
        wanted.withColumn("_seller_key", F.lower("_seller"))
        .join(sellers, "_seller_key")
        .join(by_name, ["_name", "_stat_seller"])
        .groupBy("_name", "_seller")
        .agg(best.alias("_pair"))
    )
    single = by_name.groupBy("_name").agg(best.alias("_single"))
    return (
        wanted.join(pair, ["_name", "_seller"], "left")
        .join(single, "_name", "left")
        .select("_name", "_seller", F.coalesce("_pair", "_single").alias("stat"))
    )


def with_price_reference(
    lines: DataFrame, stats: DataFrame, match: str = "exact"
) -> DataFrame:
    """Priced, named line items with the statistics row they are compared with.

    Statistics of item and seller come first, those of the item alone second.
    """
    named = lines.filter(
        (F.col("row_type") == "line_item")
        & (F.col("unit_price") > 0)
        & (strip(F.col("item_name")) != "")
    ).withColumns(
        {
            "_name": F.lower(strip(F.col("item_name"))),
            "_seller": F.nullif(F.col("seller_name"), F.lit("")),
        }
    )
    if match == "contains":
        wanted = named.select("_name", "_seller").distinct()
        found = _lookup_contains(wanted, stats).withColumnRenamed("_name", "_n")
        found = found.withColumnRenamed("_seller", "_s")
        return (
            named.join(
                found, (F.col("_name") == F.col("_n")) & F.col("_seller").eqNullSafe(F.col("_s"))
            )
            .filter(F.col("stat").isNotNull())
            .drop("_n", "_s")
        )
    figures, order = ["occurrence_count", "min_price", "max_price", "avg_price"], ["hs_code", "_seller", "currency"]
    stat = F.struct(*figures)
    renamed = shared(
        stats.withColumnsRenamed({"item_name_normalized": "_name", "seller_name": "_seller"})
        .select("_name", *order, *figures)
    )

    def best(keys: list[str]) -> DataFrame:
        rest = [F.col(c) for c in order if c not in keys]
        return renamed.groupBy(*keys).agg(
            F.min_by(stat, F.struct(-F.col("occurrence_count"), *rest)).alias("stat")
        )

    # Only lines without statistics of item and seller go by the item alone, and only these
    # are shuffled for it.
    met = unfiltered(named.join(best(["_name", "_seller"]), ["_name", "_seller"], "left"))
    alone = met.filter("stat IS NULL").drop("stat").join(best(["_name"]), "_name")
    return met.filter("stat IS NOT NULL").unionByName(alone)


def price_anomalies(
    lines: DataFrame, stats: DataFrame, threshold: float = 0.20, match: str = "exact"
) -> DataFrame:
    """Lines priced further than `threshold` from a mean of at least two records."""
    deviation = relative_deviation(F.col("unit_price"), F.col("stat.avg_price"))
    return (
        with_price_reference(lines, stats, match)
        .filter((F.col("stat.occurrence_count") >= 2) & (F.col("stat.avg_price") > 0))
        .withColumn("deviation", deviation)
        .filter(F.col("deviation") > threshold)
        .select(
            "invoice_id",
            F.col("id").alias("item_id"),
            "line_number",
            "item_name",
            "unit_price",
            F.when(F.col("unit_price") > F.col("stat.avg_price"), "above")
            .otherwise("below")
            .alias("direction"),
            "deviation",
            "stat.*",
        )
    )


def price_anomaly_issues(
    lines: DataFrame, stats: DataFrame, threshold: float = 0.20, match: str = "exact"
) -> DataFrame:
    found = price_anomalies(lines, stats, threshold, match)
    # Means are sums in any order; their last bits must not decide about half a cent.
    def figure(value: Column) -> Column:
        return F.round(value, 6)

    message = F.format_string(
        "Line %d '%s': unit price %.2f is %s%% %s historical average %.2f "
        "(range %.2f–%.2f, %d records)",
        "line_number", "item_name", figure(F.col("unit_price")),
        F.round(figure(F.col("deviation") * 100), 1), "direction", figure(F.col("avg_price")),
        figure(F.col("min_price")), figure(F.col("max_price")), "occurrence_count",
    )
    return _issues(
        found,
        [F.col("invoice_id"), F.col("item_id"), F.col("line_number")],
        [Rule(F.lit(True), "PRICE_ANOMALY", "warning", "price_anomaly",
                _line_field("unit_price"), message, F.round("avg_price", 2),
                F.round("unit_price", 2))],
    )


def repeat_purchases(
    lines: DataFrame, invoices: DataFrame, history: DataFrame, window_days: int = 30
) -> DataFrame:
    """Lines whose item and seller already occur 1..`window_days` days earlier.

    Records are first counted per item, seller and day. Days are filed in spans of
    four windows, the last of a span under the next one too, so a line finds all its
    earlier days in one row of at most five windows, and no pairs are emitted.
    """
    dated = invoices.filter(F.col("invoice_date").isNotNull()).select(
        F.col("id").alias("invoice_id"), "invoice_date"
    )
    probes = (
        lines.filter(
            (F.col("row_type") == "line_item")
            & (strip(F.col("item_name")) != "")
            & (strip(F.col("seller_name")) != "")
        )
        .join(dated, "invoice_id")
        .withColumn("_name", F.lower(strip(F.col("item_name"))))
    )
    def span(day: Column) -> Column:
        return F.floor(day / max(4 * window_days, 1))

    daily = (
        history.filter(F.col("invoice_date").isNotNull())
        .groupBy(
            F.col("item_name_normalized").alias("_name"), "seller_name",
            F.unix_date("invoice_date").alias("_day"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    filed = (
        daily.withColumn(
            "_span",
            F.explode(F.array_distinct(F.array(span(F.col("_day")), span(F.col("_day") + window_days)))),
        )
        .groupBy("_name", "seller_name", "_span")
        .agg(F.collect_list(F.struct("_day", "_n")).alias("_days"))
    )
    day = F.unix_date("invoice_date")
    prior = F.filter("_days", lambda d: (d["_day"] >= day - window_days) & (d["_day"] < day))
    return (
        probes.withColumn("_span", span(day))
        .join(filed, ["_name", "seller_name", "_span"])
        .withColumn("_days", prior)
        .filter(F.size("_days") > 0)
        .select(
            "invoice_id", F.col("id").alias("item_id"), "line_number", "item_name", "seller_name",
            "invoice_date",
            F.aggregate("_days", F.lit(0).cast("long"), lambda n, d: n + d["_n"]).alias("prior_records"),
            F.array_sort(F.transform("_days", lambda d: F.date_from_unix_date(d["_day"]))).alias("prior_dates"),
        )
    )


def repeat_purchase_issues(
    lines: DataFrame, invoices: DataFrame, history: DataFrame, window_days: int = 30
) -> DataFrame:
    found = repeat_purchases(lines, invoices, history, window_days)
    message = F.format_string(
        f"Line %d '%s': same item+seller appeared on %d prior record(s) "
        f"within {window_days} days (dates: %s)",
        "line_number", "item_name", "prior_records",
        F.array_join(F.col("prior_dates").cast("array<string>"), ", "),
    )
    field = F.concat(F.lit("items["), F.col("line_number"), F.lit("]"))
    return _issues(
        found,
        [F.col("invoice_id"), F.col("item_id"), F.col("line_number")],
        [Rule(F.lit(True), "CROSS_INVOICE_DUPLICATE", "warning", "cross_invoice_duplicate",
                field, message)],
    )


def audit_issues(
    invoices: DataFrame,
    lines: DataFrame,
    as_of: Column,
    history: DataFrame | None = None,
    stats: DataFrame | None = None,
    threshold: float = 0.20,
    window_days: int = 30,
    match: str = "exact",
) -> DataFrame:
    """All rules over all invoices as one issue table."""
    parts = [header_issues(invoices, lines, as_of), line_issues(lines), duplicate_issues(lines)]
    if stats is not None:
        parts.append(price_anomaly_issues(lines, stats, threshold, match))
    if history is not None:
        parts.append(repeat_purchase_issues(lines, invoices, history, window_days))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues.select(*ISSUE_COLUMNS)


def select_rules(issues: DataFrame, rules: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Keep some rule codes; in strict mode every warning is an error."""
    if rules:
        issues = issues.filter(F.col("code").isin(rules))
    if strict:
        issues = issues.withColumn(
            "severity",
            F.when(F.col("severity") == "warning", "error").otherwise(F.col("severity")),
        )
    return issues


def audit_rollup(invoices: DataFrame, issues: DataFrame) -> DataFrame:
    """Verdict and confidence per invoice; an invoice without issues scores 1.0."""
    counts = issues.groupBy("invoice_id").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    joined = invoices.select(F.col("id").alias("invoice_id")).join(counts, "invoice_id", "left")
    errors = F.coalesce("error_count", F.lit(0))
    warnings = F.coalesce("warning_count", F.lit(0))
    return joined.select(
        "invoice_id",
        errors.alias("error_count"),
        warnings.alias("warning_count"),
        (errors == 0).alias("passed"),
        F.when(errors == 0, "PASS").otherwise("FAIL").alias("status"),
        F.greatest(F.lit(0.0), 1.0 - (errors * 0.15 + warnings * 0.05)).alias("confidence"),
    )


def latest_audit(audits: DataFrame) -> DataFrame:
    """The newest audit per invoice by (created_at, id), without sorting groups."""
    row = F.struct(*[F.col(c) for c in audits.columns if c != "invoice_id"])
    newest = audits.groupBy("invoice_id").agg(
        F.max_by(row, F.struct("created_at", "id")).alias("_row")
    )
    return newest.select("invoice_id", "_row.*")


def validation_warnings(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """The lighter check run right after extraction: (invoice_id, line_number, warning)."""
    qty, price, total = F.col("quantity"), F.col("unit_price"), F.col("total_price")
    expected = line_total(qty, price)
    line_rules = [
        F.when(_blank(F.col("item_name")), _line_message(": Missing description")),
        F.when(qty <= 0, _line_message(F.concat(F.lit(": Invalid quantity ("), qty, F.lit(")")))),
        F.when(price < 0, _line_message(
            F.concat(F.lit(": Negative unit price ("), price, F.lit(")")))),
        F.when(
            ~line_total_ok(qty, price, total),
            _line_message(F.concat(F.lit(": Total mismatch (got "), total, F.lit(", expected "),
                                   expected, F.lit(")"))),
        ),
    ]
    per_line = lines.select(
        "invoice_id", "line_number",
        F.explode(F.array_compact(F.array(*line_rules))).alias("warning"),
    )
    header = with_line_sums(invoices, lines)
    total_amount = F.col("total_amount")
    header_rules = [
        F.when(_blank(F.col("invoice_no")), F.lit("Missing invoice number")),
        F.when(_blank(F.col("seller_name")), F.lit("Missing seller name")),
        F.when(F.col("invoice_date").isNull(), F.lit("Missing invoice date")),
        F.when(F.col("_line_count").isNull(), F.lit("No line items found")),
        F.when(
            _nonzero(total_amount) & (F.abs(total_amount - F.col("_line_sum")) > 0.02),
            F.concat(F.lit("Total mismatch: declared "), total_amount, F.lit(" vs calculated "),
                     F.format_string("%.2f", F.col("_line_sum"))),
        ),
    ]
    per_header = header.select(
        F.col("id").alias("invoice_id"),
        F.lit(None).cast("int").alias("line_number"),
        F.explode(F.array_compact(F.array(*header_rules))).alias("warning"),
    )
    return per_header.unionByName(per_line)


def parse_findings(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Issues from the JSON list inside a free-text review, one row per finding."""
    body = F.regexp_extract(F.col(text_col), r"(?s)(\[.*\])", 1)
    schema = "array<struct<issue:string,severity:string,line:int>>"
    return (
        responses.select("invoice_id", F.explode(F.from_json(body, schema)).alias("f"))
        .filter(F.col("f.issue").isNotNull())
        .select(
            "invoice_id",
            F.lit("LLM_FINDING").alias("code"),
            F.when(F.col("f.severity") == "error", "error").otherwise("warning").alias("severity"),
            F.lit("llm_analysis").alias("category"),
            F.col("f.issue").alias("message"),
            F.when(F.coalesce(F.col("f.line"), F.lit(0)) != 0,
                   F.concat(F.lit("items["), F.col("f.line") - 1, F.lit("]")))
            .otherwise("").alias("field"),
        )
    )
