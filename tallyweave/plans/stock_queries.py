"""Stock balances, the weighted-average-cost ledger and sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import inventory
from tallyweave.operators.ledger import stock_ledger
from tallyweave.plans import model
from tallyweave.plans.model import sql
from tallyweave.plans.registry import query

ORDER = ["seq"]
FOLD_ORDER = ["movement_date", "seq"]


@query("stock_balance", sql("""
    SELECT item_id, id, movement_date, movement_type, quantity,
           sum(CASE WHEN movement_type = 'in' THEN quantity ELSE -quantity END) OVER (
               PARTITION BY item_id ORDER BY movement_date, l_orderkey, l_linenumber, l_suppkey,
               cents ROWS UNBOUNDED PRECEDING) AS balance
    FROM mov""", "mov"))
def stock_balance(spark, sf):
    balance = inventory.stock_balance(model.stock_movements(spark, sf), ORDER)
    return balance.select(
        "item_id", "id", "movement_date", "movement_type", "quantity", "balance"
    )


_FOLD = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY movement_date,
               l_orderkey, l_linenumber, l_suppkey, cents) AS rn FROM mov),
    fold AS (
        SELECT item_id, rn, id, movement_type, movement_date, quantity, reference,
               movement_type = 'in' AS accepted,
               CASE WHEN movement_type = 'in' THEN unit_cost ELSE 0::DOUBLE END AS applied_cost,
               CASE WHEN movement_type = 'in' THEN quantity ELSE 0::DOUBLE END AS held,
               CASE WHEN movement_type = 'in' THEN unit_cost ELSE 0::DOUBLE END AS mean
        FROM ranked WHERE rn = 1
        UNION ALL
        SELECT r.item_id, r.rn, r.id, r.movement_type, r.movement_date, r.quantity, r.reference,
               r.movement_type = 'in' OR f.held >= r.quantity,
               CASE WHEN r.movement_type = 'in' THEN r.unit_cost ELSE f.mean END,
               CASE WHEN r.movement_type = 'in' THEN f.held + r.quantity
                    WHEN f.held >= r.quantity THEN f.held - r.quantity ELSE f.held END,
               CASE WHEN r.movement_type = 'in'
                    THEN (f.held * f.mean + r.quantity * r.unit_cost) / (f.held + r.quantity)
                    ELSE f.mean END
        FROM fold f JOIN ranked r ON r.item_id = f.item_id AND r.rn = f.rn + 1)"""


def _ledger(spark, sf):
    return stock_ledger(model.stock_movements(spark, sf), FOLD_ORDER)


@query("wac_ledger", sql("""
    SELECT item_id, id, movement_type, movement_date, quantity, accepted,
           rnd(applied_cost) AS applied_cost, held AS quantity_on_hand, rnd(mean) AS avg_cost
    FROM fold""", "mov", extra=_FOLD, recursive=True))
def wac_ledger(spark, sf):
    return _ledger(spark, sf).select(
        "item_id", "id", "movement_type", "movement_date", "quantity", "accepted",
        model.rounded("applied_cost").alias("applied_cost"), "quantity_on_hand",
        model.rounded("avg_cost").alias("avg_cost"),
    )


_STATE = """,
    state AS (SELECT item_id, held, mean FROM fold
              QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rn DESC) = 1)"""


@query("inventory_items", sql("""
    SELECT s.item_id, held AS quantity_on_hand, rnd(mean) AS avg_cost, m.last_movement_date
    FROM state s JOIN (SELECT item_id, max(movement_date) FILTER (accepted) AS last_movement_date
                       FROM fold GROUP BY 1) m ON m.item_id = s.item_id""",
    "mov", extra=_FOLD + _STATE, recursive=True))
def inventory_items(spark, sf):
    items = inventory.inventory_items(_ledger(spark, sf), ORDER)
    return items.withColumn("avg_cost", model.rounded("avg_cost"))


@query("low_stock", sql("""
    SELECT item_id, held AS quantity_on_hand FROM state WHERE held <= 10""",
    "mov", extra=_FOLD + _STATE, recursive=True))
def low_stock(spark, sf):
    items = inventory.inventory_items(_ledger(spark, sf), ORDER)
    return inventory.low_stock(items).select("item_id", "quantity_on_hand")


@query("inventory_kpis", sql("""
    SELECT count(*) AS items, round(sum((held * mean)::DECIMAL(28, 8)), 2)::DOUBLE AS stock_value,
           count(*) FILTER (held <= 10) AS low_stock
    FROM state""", "mov", extra=_FOLD + _STATE, recursive=True))
def inventory_kpis(spark, sf):
    kpis = inventory.inventory_kpis(inventory.inventory_items(_ledger(spark, sf), ORDER))
    return kpis.withColumn("stock_value", F.col("stock_value").cast("double"))


def _sale_lines(spark, sf):
    movements = model.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_linestatus") == "F", "in").otherwise("out").alias("movement_type"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        F.col("l_shipdate").cast("date").alias("movement_date"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        ).alias("seq"),
        F.col("l_orderkey").alias("reference"),
    )
    return inventory.sale_lines(stock_ledger(movements, FOLD_ORDER))


_SALES = """,
    lines AS (SELECT f.reference, f.accepted, l.l_extendedprice AS line_total,
                     f.applied_cost * f.quantity AS cost, l.l_extendedprice * l.l_tax AS tax
              FROM fold f JOIN (SELECT *, {key} AS id FROM lineitem) l ON l.id = f.id
              WHERE f.movement_type = 'out'),
    sales AS (SELECT reference, count(*) FILTER (accepted) AS line_count,
                     count(*) FILTER (NOT accepted) AS rejected_lines,
                     coalesce(sum(line_total) FILTER (accepted), 0) AS subtotal,
                     coalesce(sum(tax) FILTER (accepted), 0) AS tax_amount,
                     coalesce(sum(cost) FILTER (accepted), 0) AS total_cost
              FROM lines GROUP BY 1)""".format(key=model._KEY)

_SALES_SELECT = """
    SELECT reference, line_count, rejected_lines, rnd(subtotal) AS subtotal,
           rnd(tax_amount) AS tax_amount, rnd(total_cost) AS total_cost,
           rnd(subtotal + tax_amount) AS total_amount,
           rnd(subtotal + tax_amount - total_cost) AS total_profit,
           rnd(subtotal - total_cost) AS profit_ex_tax
    FROM sales WHERE {kept}"""

_MONEY = ("subtotal", "tax_amount", "total_cost", "total_amount", "total_profit", "profit_ex_tax")


@query("sales_totals", sql(_SALES_SELECT.format(kept="line_count > 0"), "mov",
                           extra=_FOLD + _SALES, recursive=True))
def sales_totals(spark, sf):
    totals = inventory.sales_totals(_sale_lines(spark, sf))
    return totals.withColumns({c: model.rounded(c) for c in _MONEY})


@query("sales_totals_whole", sql(_SALES_SELECT.format(kept="rejected_lines = 0"), "mov",
                                 extra=_FOLD + _SALES, recursive=True))
def sales_totals_whole(spark, sf):
    totals = inventory.sales_totals(_sale_lines(spark, sf), reject="invoice")
    return totals.withColumns({c: model.rounded(c) for c in _MONEY})


@query("sales_kpis", sql("""
    SELECT count(*) AS sales, round(sum((subtotal + tax_amount)::DECIMAL(28, 8)), 2)::DOUBLE AS revenue,
           round(sum((subtotal + tax_amount - total_cost)::DECIMAL(28, 8)), 2)::DOUBLE AS profit
    FROM sales WHERE line_count > 0""", "mov", extra=_FOLD + _SALES, recursive=True))
def sales_kpis(spark, sf):
    kpis = inventory.sales_kpis(inventory.sales_totals(_sale_lines(spark, sf)))
    return kpis.withColumns(
        {c: F.col(c).cast("double") for c in ("revenue", "profit")}
    )


@query("movements_of_known_materials", sql("""
    SELECT id, item_id FROM mov
    WHERE item_id IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')""", "mov"))
def movements_of_known_materials(spark, sf):
    known = model.table(spark, sf, "part").filter("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("item_id")
    )
    return inventory.known_materials(model.stock_movements(spark, sf), known).select(
        "id", "item_id"
    )


@query("movements_of_unknown_materials", sql("""
    SELECT id, item_id FROM mov
    WHERE item_id NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')""", "mov"))
def movements_of_unknown_materials(spark, sf):
    known = model.table(spark, sf, "part").filter("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("item_id")
    )
    return inventory.unknown_materials(model.stock_movements(spark, sf), known).select(
        "id", "item_id"
    )
