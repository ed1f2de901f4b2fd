"""The driver's star-schema tables seen as the model tables.

Each function reads only the columns it needs once Catalyst has pruned the plan.
`CTES` holds the same definitions as SQL for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.partitioning import shared, small_side

AS_OF = "2001-08-01"


def as_of():
    return F.lit(AS_OF).cast("date")


def rounded(c):
    """Four decimals. The offset keeps exact decimal ties off the rounding edge, so the
    result does not hang on the last bit of a sum; `rnd(...)` in the SQL does the same."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10000 + 0.50037) / 10000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_key():
    """Text key of one order line; every part is an integer, so it prints the same anywhere."""
    return F.concat_ws(
        "-",
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.round(F.col("l_extendedprice") * 100).cast("long"),
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


def invoice_headers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("INV-"), F.col("o_orderkey")).alias("invoice_no"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.lit("USD").alias("currency"),
        F.col("o_totalprice").alias("total_amount"),
        (F.col("o_orderstatus") != "P").alias("is_latest"),
        F.col("o_custkey").alias("customer_id"),
    )


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Headers with buyer, seller, due date, subtotal and tax taken from the lines."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.sum(net).alias("subtotal"),
            F.sum(net * F.col("l_tax")).alias("tax_amount"),
            F.min("l_suppkey").alias("supplier_id"),
            F.min(F.col("l_shipdate").cast("date")).alias("due_date"),
        )
    )
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("buyer_name"),
        F.col("c_mktsegment").alias("company_key"),
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("seller_name")
    )
    return (
        invoice_headers(spark, sf)
        .join(customer, "customer_id", "left")
        .join(per_order, "id", "left")
        .join(small_side(supplier), "supplier_id", "left")
        .drop("customer_id", "supplier_id")
    )


def lines_with_parts(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """Order lines and their parts for queries that see them in several ways, joined once for all."""
    line = table(spark, sf, "lineitem").drop("l_discount", "l_tax", "l_linestatus")
    return shared(_joined(line, table(spark, sf, "part").drop("p_size")), *keys)


def _joined(line: DataFrame, part: DataFrame) -> DataFrame:
    return line.join(part, line.l_partkey == part.p_partkey)


def _lines(spark: SparkSession, sf: str, lines: DataFrame | None) -> DataFrame:
    return _joined(table(spark, sf, "lineitem"), table(spark, sf, "part")) if lines is None else lines


def invoice_items(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    line = _lines(spark, sf, lines)
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return (
        line.join(small_side(supplier), line.l_suppkey == supplier.s_suppkey)
        .select(
            line_key().alias("id"),
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("p_name").alias("item_name"),
            F.col("p_type").alias("hs_code"),
            F.col("p_brand").alias("brand"),
            F.col("s_name").alias("seller_name"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_extendedprice").alias("total_price"),
            F.lit("line_item").alias("row_type"),
            F.when(F.col("l_returnflag") == "A", F.col("p_partkey").cast("string")).alias(
                "matched_material_id"
            ),
        )
    )


def invoice_items_listed(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Lines priced from the list price, so that duplicates and wrong totals occur."""
    unit_price = (100 * F.floor(F.col("p_retailprice") / 100)).cast("double")
    extra = F.when(F.col("l_returnflag") == "R", 1.5).otherwise(0.0)
    return _lines(spark, sf, lines).select(
        line_key().alias("id"),
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("hs_code"),
        F.col("l_quantity").alias("quantity"),
        unit_price.alias("unit_price"),
        (F.col("l_quantity") * unit_price + extra).alias("total_price"),
        F.lit("line_item").alias("row_type"),
    )


def materials(spark: SparkSession, sf: str) -> DataFrame:
    """One material per lower-case part name."""
    return (
        table(spark, sf, "part")
        .groupBy(F.lower(F.trim("p_name")).alias("normalized_name"))
        .agg(F.min("p_partkey").alias("_id"), F.min("p_type").alias("hs_code"))
        .select(
            F.col("_id").cast("string").alias("id"),
            F.col("normalized_name").alias("name"),
            "normalized_name",
            "hs_code",
        )
    )


def synonyms(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(
        F.lower(F.trim("p_name")).alias("normalized_name"),
        F.concat_ws(" ", "p_brand", "p_name").alias("synonym"),
    )
    ids = materials(spark, sf).select(F.col("id").alias("material_id"), "normalized_name")
    return part.distinct().join(ids, "normalized_name").select("material_id", "synonym")


def stock_movements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_linestatus") == "F", "in").otherwise("out").alias("movement_type"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"),
        F.col("l_shipdate").cast("date").alias("movement_date"),
        F.struct(
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        ).alias("seq"),
        line_key().alias("id"),
        F.col("l_orderkey").alias("reference"),
    )


def company_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Permit "), F.col("o_orderkey")).alias("title"),
        F.lit("permit").alias("document_type"),
        F.date_add(F.col("o_orderdate").cast("date"), 365).alias("expiry_date"),
        F.col("o_orderdate").cast("date").alias("issued_date"),
    )


def reminders(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Renew permit "), F.col("o_orderkey")).alias("title"),
            F.date_add(F.col("o_orderdate").cast("date"), 365).alias("due_date"),
            (F.col("o_orderstatus") == "F").alias("is_done"),
            F.lit("company_document").alias("linked_entity_type"),
            F.col("o_orderkey").alias("linked_entity_id"),
        )
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Text documents; the even sources carry the current version."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("company_key"),
        F.lit("indexed").alias("status"),
        (F.col("lang") != "de").alias("is_latest"),
    )


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        "doc_id",
        F.lit(1).alias("page_no"),
        F.col("source").alias("page_type"),
        "text",
    )


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.size(F.split("text", " ")).alias("token_count"),
    )


_KEY = (
    "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
    "CAST(round(l_extendedprice * 100) AS BIGINT) || '-' || strftime(l_shipdate, '%Y%m%d')"
)

CTES: dict[str, str] = {
    "hdr": """
        SELECT o_orderkey AS id, 'INV-' || o_orderkey AS invoice_no,
               CAST(o_orderdate AS DATE) AS invoice_date, 'USD' AS currency,
               o_totalprice AS total_amount, o_orderstatus <> 'P' AS is_latest,
               o_custkey AS customer_id
        FROM orders""",
    "inv": """
        SELECT h.id, h.invoice_no, h.invoice_date, h.currency, h.total_amount, h.is_latest,
               c.c_name AS buyer_name, c.c_mktsegment AS company_key, a.subtotal, a.tax_amount,
               s.s_name AS seller_name, a.due_date
        FROM hdr h LEFT JOIN customer c ON c.c_custkey = h.customer_id
        LEFT JOIN (
            SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS subtotal,
                   sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax_amount,
                   min(l_suppkey) AS supplier_id, min(CAST(l_shipdate AS DATE)) AS due_date
            FROM lineitem GROUP BY 1) a ON a.l_orderkey = h.id
        LEFT JOIN supplier s ON s.s_suppkey = a.supplier_id""",
    "items": f"""
        SELECT {_KEY} AS id, l_orderkey AS invoice_id, l_linenumber AS line_number,
               p_name AS item_name, p_type AS hs_code, p_brand AS brand, s_name AS seller_name,
               l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
               l_extendedprice AS total_price, 'line_item' AS row_type,
               CASE WHEN l_returnflag = 'A' THEN CAST(p_partkey AS VARCHAR) END
                   AS matched_material_id
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "listed": f"""
        SELECT {_KEY} AS id, l_orderkey AS invoice_id, l_linenumber AS line_number,
               p_name AS item_name, p_type AS hs_code, l_quantity AS quantity,
               CAST(100 * floor(p_retailprice / 100) AS DOUBLE) AS unit_price,
               l_quantity * CAST(100 * floor(p_retailprice / 100) AS DOUBLE)
                   + CASE WHEN l_returnflag = 'R' THEN 1.5::DOUBLE ELSE 0::DOUBLE END
                   AS total_price,
               'line_item' AS row_type
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "hist": """
        SELECT lower(trim(i.item_name)) AS item_name_normalized, i.hs_code, i.seller_name,
               i.invoice_id, v.invoice_date, i.quantity, i.unit_price, v.currency
        FROM items i JOIN hdr v ON v.id = i.invoice_id
        WHERE i.row_type = 'line_item' AND i.unit_price > 0""",
    "stats": """
        SELECT item_name_normalized, hs_code, seller_name, currency, count(*) AS occurrence_count,
               min(unit_price) AS min_price, max(unit_price) AS max_price,
               avg(unit_price) AS avg_price, min(invoice_date) AS first_seen,
               max(invoice_date) AS last_seen
        FROM hist GROUP BY 1, 2, 3, 4""",
    "mat": """
        SELECT CAST(min(p_partkey) AS VARCHAR) AS id, lower(trim(p_name)) AS name,
               lower(trim(p_name)) AS normalized_name, min(p_type) AS hs_code
        FROM part GROUP BY 2, 3""",
    "syn": """
        SELECT DISTINCT m.id AS material_id, p_brand || ' ' || p_name AS synonym
        FROM part JOIN mat m ON m.normalized_name = lower(trim(p_name))""",
    "mov": f"""
        SELECT l_partkey AS item_id, CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'out' END
                   AS movement_type, l_quantity AS quantity,
               l_extendedprice / l_quantity AS unit_cost,
               CAST(l_shipdate AS DATE) AS movement_date, l_orderkey, l_linenumber, l_suppkey,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, {_KEY} AS id,
               l_orderkey AS reference
        FROM lineitem""",
    "cdoc": """
        SELECT o_orderkey AS id, 'Permit ' || o_orderkey AS title, 'permit' AS document_type,
               CAST(o_orderdate AS DATE) + 365 AS expiry_date,
               CAST(o_orderdate AS DATE) AS issued_date
        FROM orders""",
    "rem": """
        SELECT o_orderkey AS id, 'Renew permit ' || o_orderkey AS title,
               CAST(o_orderdate AS DATE) + 365 AS due_date, o_orderstatus = 'F' AS is_done,
               'company_document' AS linked_entity_type, o_orderkey AS linked_entity_id
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "doc": """
        SELECT doc_id AS id, 'doc-' || doc_id || '.txt' AS filename, lang AS company_key,
               'indexed' AS status, lang <> 'de' AS is_latest
        FROM documents""",
    "page": """
        SELECT doc_id AS id, doc_id, 1 AS page_no, source AS page_type, text FROM documents""",
    "msg": """
        SELECT conv_id AS session_id, turn, role, text AS content,
               CAST(len(string_split(text, ' ')) AS INTEGER) AS token_count
        FROM conversations""",
}

_NEEDS = {"inv": ["hdr"], "hist": ["items", "hdr"], "stats": ["hist"], "syn": ["mat"]}


def _expand_rounding(text: str) -> str:
    """Replace each `rnd(expression)` by its arithmetic."""
    while (start := text.find("rnd(")) >= 0:
        depth, end = 1, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[start + 4 : end - 1]
        text = f"{text[:start]}(floor(({inner}) * 10000 + 0.50037::DOUBLE) / 10000){text[end:]}"
    return text


def sql(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """`body` behind the WITH clauses it names (and those these need), then `extra` ones."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    clauses = [f"{name} AS ({CTES[name]})" for name in ordered] + ([extra] if extra else [])
    if not clauses:
        return _expand_rounding(body)
    word = "WITH RECURSIVE" if recursive else "WITH"
    return _expand_rounding(f"{word} {', '.join(clauses)}\n{body}")
