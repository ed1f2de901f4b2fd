"""Stock balances, inventory and sales figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_materials(movements: DataFrame, materials: DataFrame) -> DataFrame:
    """Movements whose material exists."""
    return movements.join(materials.select("item_id").distinct(), "item_id", "left_semi")


def unknown_materials(movements: DataFrame, materials: DataFrame) -> DataFrame:
    """The reject table: movements of materials that do not exist."""
    return movements.join(materials.select("item_id").distinct(), "item_id", "left_anti")


def stock_balance(movements: DataFrame, order: list[str]) -> DataFrame:
    """Running balance per item when nothing is rejected.

    Days are summed first and carried over as offsets, so a task only sorts the
    movements of one item and day; one shuffle of the rows, as for a plain window.
    """
    signed = F.when(F.col("movement_type") == "in", F.col("quantity")).otherwise(
        -F.col("quantity")
    )
    rows = movements.withColumn("_signed", signed)
    before = (
        Window.partitionBy("item_id")
        .orderBy("movement_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy("item_id", "movement_date")
        .agg(F.sum("_signed").alias("_day"))
        .withColumn("_carried", F.coalesce(F.sum("_day").over(before), F.lit(0.0)))
        .drop("_day")
    )
    inside = (
        Window.partitionBy("item_id", "movement_date")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_inside", F.sum("_signed").over(inside))
        .join(offsets, ["item_id", "movement_date"])
        .withColumn("balance", F.col("_carried") + F.col("_inside"))
        .drop("_signed", "_inside", "_carried")
    )


def inventory_items(ledger: DataFrame, order: list[str]) -> DataFrame:
    """State per item after its last movement, without sorting the movements again."""
    at = F.struct("movement_date", *order)
    state = F.struct("quantity_on_hand", "avg_cost")
    return (
        ledger.groupBy("item_id")
        .agg(
            F.max_by(state, at).alias("_s"),
            F.max(F.when(F.col("accepted"), F.col("movement_date"))).alias("last_movement_date"),
        )
        .select("item_id", "_s.*", "last_movement_date")
    )


def _money_sum(amount: Column) -> Column:
    """Sum to the cent that does not hang on the order of the rows."""
    return F.round(F.sum(amount.cast("decimal(28,8)")), 2)


def low_stock(items: DataFrame, threshold: float = 10.0) -> DataFrame:
    return items.filter(F.col("quantity_on_hand") <= threshold)


def inventory_kpis(items: DataFrame, threshold: float = 10.0) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        _money_sum(F.col("quantity_on_hand") * F.col("avg_cost")).alias("stock_value"),
        F.count_if(F.col("quantity_on_hand") <= threshold).alias("low_stock"),
    )


def sale_lines(ledger: DataFrame) -> DataFrame:
    """Sale lines with cost basis, line total and profit; one per issue movement."""
    total = F.col("quantity") * F.col("unit_price")
    cost = F.col("applied_cost") * F.col("quantity")
    return ledger.filter("movement_type = 'out'").withColumns(
        {"line_total": total, "cost_basis": cost, "profit": total - cost}
    )


def sales_totals(lines: DataFrame, reject: str = "line") -> DataFrame:
    """Totals per sale. Collected tax counts as profit; `profit_ex_tax` leaves it out.

    `reject="line"` drops the lines without stock, `reject="invoice"` drops every
    sale that has such a line (its accepted issues stay in the ledger).
    """
    totals = lines.groupBy("reference").agg(
        F.count_if("accepted").alias("line_count"),
        F.count_if(~F.col("accepted")).alias("rejected_lines"),
        *[
            F.sum(F.when(F.col("accepted"), F.col(c)).otherwise(0.0)).alias(out)
            for c, out in (
                ("line_total", "subtotal"), ("tax", "tax_amount"), ("cost_basis", "total_cost")
            )
        ],
    )
    kept = totals.filter("line_count > 0" if reject == "line" else "rejected_lines = 0")
    return (
        kept.withColumn("total_amount", F.col("subtotal") + F.col("tax_amount"))
        .withColumn("total_profit", F.col("total_amount") - F.col("total_cost"))
        .withColumn("profit_ex_tax", F.col("subtotal") - F.col("total_cost"))
    )


def sales_kpis(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count(F.lit(1)).alias("sales"),
        _money_sum(F.col("total_amount")).alias("revenue"),
        _money_sum(F.col("total_profit")).alias("profit"),
    )
