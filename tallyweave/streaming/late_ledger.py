"""A stock ledger over a stream whose movements come late, in order of their own time.

Movements wait until the watermark (the newest time seen less `delay_seconds`) has passed them.
What is due is then folded by `stock_ledger`, in its stretches, from the stock that the items
had: so an item with a third of all rows is spread over tasks here too. Rows that come behind
the watermark can no longer change what was written; they go to a table of their own, and so
do rows without a time.

A step is one micro-batch, or a closing of the books. It writes its ledger rows, the stock of
the items it touched, what still waits and what came late under its number, and counts once its
commit exists. Steps read committed steps only, so a step repeated after a crash starts from the
same stock and replaces what was cut short. There is one writer. Every `compact` batches the
stock of all items is written, and later steps read no older ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.ledger import UNIT, stock_ledger
from tallyweave.session import cut_lineage

FIELDS = ["item_id", "id", "movement_type", "quantity", "unit_cost", "movement_time"]


def _newest(stock: DataFrame) -> DataFrame:
    """(item_id, units, mean) as the last step left them."""
    return stock.groupBy("item_id").agg(F.max_by(F.struct("units", "mean"), "step").alias("_s")).select(
        "item_id", "_s.units", "_s.mean")


@dataclass(frozen=True)
class LateLedger:
    """Movements (item_id, id, movement_type, quantity, unit_cost, movement_time) in a shared folder.

    Ids are unique within an item; movements of one time are taken in order of their ids.
    """

    spark: SparkSession
    path: str
    delay_seconds: int = 86_400
    compact: int = 16
    stretches: int | None = None

    # Writing

    def follow(self, movements: DataFrame, checkpoint: str):
        """Take in what has arrived in a stream, batch by batch, then stop."""
        return movements.writeStream.foreachBatch(self.write_batch).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write_batch(self, movements: DataFrame, number: int) -> None:
        """One micro-batch; a number that is committed already changes nothing."""
        last = self._last()
        if last is None or last["step"] < 2 * number:
            self._advance(movements, 2 * number, last, close=False)

    def close(self) -> None:
        """Settle all that waits, as if nothing earlier could still come."""
        last = self._last()
        if last is not None and last["step"] % 2 == 0:
            self._advance(self._waiting(last).drop("_at"), last["step"] + 1, last, close=True)

    def _advance(self, movements: DataFrame, step: int, last: Row | None, close: bool) -> None:
        time = F.unix_micros(F.col("movement_time").cast("timestamp"))
        come = movements.select(*FIELDS).withColumns(
            {"quantity": F.col("quantity").cast("double"), "unit_cost": F.col("unit_cost").cast("double"), "_at": time})
        settled = None if last is None else last["mark"]
        behind = F.col("_at").isNull() | (F.lit(False) if settled is None else F.col("_at") <= settled)
        come = come.withColumn("_late", behind)
        if last is not None and not close:
            come = come.unionByName(self._waiting(last).withColumn("_late", F.lit(False)))
        come = cut_lineage(come)
        newest = come.filter("NOT _late").agg(F.max("_at")).first()[0]
        marks = [m for m in (settled, None if newest is None else newest - (0 if close else self.delay_seconds * 1_000_000))
                 if m is not None]
        mark = max(marks, default=None)

        due = come.filter(~F.col("_late") & (F.lit(False) if mark is None else F.col("_at") <= mark))
        opening = None
        if last is not None:
            opening = self._stock(last).join(due.select("item_id").distinct(), "item_id", "left_semi")
        self._write(stock_ledger(due.drop("_late"), ["_at", "id"], self.stretches, opening), "rows", step)
        waits = F.lit(True) if mark is None else F.col("_at") > mark
        self._write(come.filter(~F.col("_late") & waits).drop("_late"), "waiting", step)
        self._write(come.filter("_late").drop("_late", "_at"), "late", step)

        end = F.max_by(F.struct(F.round(F.col("quantity_on_hand") * UNIT).cast("long").alias("units"),
                                F.col("avg_cost").alias("mean")), F.struct("_at", "id"))
        stock = self._read("rows", step).filter(F.col("step") == step).groupBy("item_id").agg(
            end.alias("_s")).select("item_id", "_s.units", "_s.mean")
        whole = last is None or step - last["base"] >= 2 * self.compact
        if whole and last is not None:
            stock = _newest(stock.withColumn("step", F.lit(1)).unionByName(
                self._stock(last).withColumn("step", F.lit(0))))
        self._write(stock, "stock", step)
        commit = self.spark.createDataFrame([(mark, step if whole else last["base"])], "mark bigint, base int")
        self._write(commit.coalesce(1), "commits", step)

    def _write(self, rows: DataFrame, table: str, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/step={step}")

    # Reading

    def ledger(self) -> DataFrame:
        """The settled movements with verdict, booked cost, quantity and mean cost after them."""
        return self._read("rows", self._known()["step"]).drop("_at", "step")

    def late(self) -> DataFrame:
        """Movements that came behind the watermark, or without a time; they are in no balance."""
        return self._read("late", self._known()["step"]).drop("step")

    def waiting(self) -> DataFrame:
        """Movements that the watermark has not passed."""
        return self._waiting(self._known()).drop("_at")

    def balances(self) -> DataFrame:
        """(item_id, quantity_on_hand, avg_cost) after the settled movements."""
        return self._stock(self._known()).select(
            "item_id", (F.col("units") / UNIT).alias("quantity_on_hand"), F.col("mean").alias("avg_cost"))

    def _known(self) -> Row:
        last = self._last()
        if last is None:
            raise ValueError(f"no batch has been committed in {self.path}")
        return last

    def _last(self) -> Row | None:
        """(step, mark, base) of the newest commit."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        commits = self.spark.read.schema("mark bigint, base int, step int").parquet(str(folder))
        return commits.orderBy(F.desc("step")).select("step", "mark", "base").first()

    def _read(self, table: str, until: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("step") <= until)

    def _waiting(self, last: Row) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/waiting/step={last['step']}")

    def _stock(self, last: Row) -> DataFrame:
        return _newest(self._read("stock", last["step"]).filter(F.col("step") >= last["base"]))
