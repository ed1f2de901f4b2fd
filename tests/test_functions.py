import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates, numbers, text


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r.v for r in df.select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]


def test_parse_number(spark):
    cases = {
        "123.45": 123.45, "100": 100.0, "1,234.56": 1234.56, "1,234,567.89": 1234567.89,
        "1.234,56": 1234.56, "1 234.56": 1234.56, "": None, "   ": None, "abc": None, "N/A": None,
        "-5": -5.0, "1.2.3": None, "$ 9,5": 9.5,
    }
    assert values(spark, list(cases), numbers.parse_number) == list(cases.values())
    assert values(spark, [None], numbers.parse_number) == [None]


def test_coerce_number(spark):
    cases = {"1,200.5": 1200.5, " 7 ": 7.0, "none": 0.0, "NaN": 0.0, "": 0.0, "x": 0.0, None: 0.0}
    assert values(spark, list(cases), numbers.coerce_number) == list(cases.values())


def test_parse_date(spark):
    day = dt.date(2024, 1, 15)
    cases = {
        "2024-01-15": day, "2024-1-5": dt.date(2024, 1, 5), "15/01/2024": day, "15.01.2024": day,
        "01/15/2024": day, "05/06/2024": dt.date(2024, 6, 5), "15 January 2024": day,
        "January 15, 2024": day, "Jan 15, 2024": day, "dated 15 jan 2024": day, "2024-13-01": None,
        "31/02/2024": None, "": None, "not a date": None, None: None,
    }
    assert values(spark, list(cases), dates.parse_date) == list(cases.values())


def test_coerce_date(spark):
    day = dt.date(2024, 1, 15)
    cases = {"2024-01-15": day, "15/01/2024": day, "01/15/2024": day, "15-01-2024": day,
             "none": None, "": None, "15.01.2024": None}
    assert values(spark, list(cases), dates.coerce_date) == list(cases.values())


@pytest.mark.parametrize(
    ("line", "bank"),
    [
        ("IBAN: DE89370400440532013000", True), ("SWIFT: COBADEFFXXX", True),
        ("Beneficiary: Test Company", True), ("Bank: First National Bank", True),
        ("Widget product description", False), ("100 PCS @ $50.00", False), ("بنك", True), ("", False),
    ],
)
def test_bank_lines(spark, line, bank):
    assert values(spark, [line], text.is_bank_line) == [bank]


def test_summary_lines(spark):
    cases = {
        "Total: 1,500.00": True, "Sub Total": True, "Grand Total": True, "VAT @ 20%": True,
        "Invoice No: INV-001": True, "ab": True, "Widget product": False, "50 PCS": False,
        "Total weight": False,
    }
    assert values(spark, list(cases), text.is_summary_line) == list(cases.values())


def test_cells(spark):
    lines = [
        "Description     100     50.00     5000.00", "Product Name Here     100     50.00",
        "  a  b ", "one", "a\tb  c",
    ]
    got = values(spark, lines, text.cells)
    assert [[c.text for c in cells] for cells in got] == [
        ["Description", "100", "50.00", "5000.00"], ["Product Name Here", "100", "50.00"],
        ["a", "b"], ["one"], ["a b", "c"],
    ]
    assert [(c.start_pos, c.end_pos) for c in got[0]] == [(0, 10), (16, 18), (24, 28), (34, 41)]
    assert [(c.start_pos, c.end_pos) for c in got[2]] == [(0, 2), (5, 7)]


def test_names(spark):
    assert values(spark, [" A  b ", None], text.normalized_name) == ["a  b", None]
    assert values(spark, [" A \t b\n"], text.match_key) == ["a b"]
    assert values(spark, ["1. Pipe  x", "2) y", " 3-z", "4 w", None], text.clean_item_name) == [
        "Pipe x", "y", "z", "4 w", "",
    ]
    assert values(spark, ["x" * 1001], lambda c: text.safe_string(c, 1000)) == ["x" * 1000 + "..."]


def test_codes_and_currency(spark):
    assert values(spark, ["8471.30", "847130", "12345", "no"], text.is_hs_code) == [True, True, False, False]
    assert values(spark, ["HS 8471.30.00 x", "none"], text.extract_hs_code) == ["84713000", None]
    cases = {"€ 5": "EUR", "5 usd": "USD", "DATE: 5 EUR": "EUR", "12 DA": "DZD", "AED 4": "AED", "": "USD"}
    assert values(spark, list(cases), text.detect_currency) == list(cases.values())
    assert values(spark, ["USD 1,200.00", "$5 "], text.strip_currency) == ["1,200.00", "5"]


def test_query_expansion(spark):
    got = values(spark, ["85.36.20.00", "85-36", "plain"], text.expand_query)
    assert got[0].split() == ["85.36.20.00", "85362000", "85", "36", "20", "00"]
    assert got[1].split() == ["85-36", "8536", "85", "36"]
    assert got[2].strip() == "plain"


def test_tokens_and_highlight(spark):
    assert values(spark, ["Élan, 10mm-Rod"], text.search_tokens) == [["elan", "10mm", "rod"]]
    assert values(spark, ["Rod (x)"], lambda c: text.highlight(c, ["(x)", "rod"])) == [
        "<em>Rod</em> <em>(x)</em>"
    ]


def test_vectors(spark):
    got = values(spark, [[3.0, 4.0], [0.0, 0.0]], numbers.l2_normalize, "array<float>")
    assert [round(x, 4) for x in got[0]] == [0.6, 0.8]
    assert got[1] == [0.0, 0.0]
