"""Incremental processing as Structured Streaming.

High-water marks become checkpoints, triggers and views become stateful queries.
Late rows: aggregates take rows in any order; the ledger applies micro-batches in
arrival order and sorts inside each; the repeat-purchase join waits for rows up to
the watermark delay and drops later ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.functions.text import normalized_name
from tallyweave.operators.chunks import chunk_documents
from tallyweave.operators.history import STATS_KEYS, price_stats
from tallyweave.operators.ledger import UNIT, step
from tallyweave.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_MB = 400


def read_stream(
    spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream; new files are picked up once each."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def work_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append what has arrived to a Parquet folder, exactly once, then stop.

    A rebuild is a run with a new checkpoint and a new folder.
    """
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def upsert_to(stream: DataFrame, path: str, checkpoint: str):
    """Write changed rows per micro-batch; a repeated batch replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def state_tasks(spark: SparkSession, count: int | None) -> Iterator[None]:
    """State of the queries started inside: how many partitions, and on disk.

    A query keeps its number of partitions for good. State in RocksDB is not bounded
    by the memory of an executor, as Spark's default in the heap is; all stores of an
    executor share what RocksDB itself may hold.
    """
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.boundedMemoryUsage": "true",
              f"{store}.rocksdb.maxMemoryUsageMB": str(STATE_MB)}
    if count:
        wanted["spark.sql.shuffle.partitions"] = str(count)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain_append(stream: DataFrame, tasks: int | None = None) -> DataFrame:
    """Run an append stream over what is there and return the written table."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    with state_tasks(spark, tasks):
        append_to(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_update(stream: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Run an update stream over what is there and return the newest row per key."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    with state_tasks(spark, tasks):
        upsert_to(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_r"))
    return newest.select(*keys, "_r.*").select(*stream.columns)


def index_pages(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """New pages as chunks; no state, so every page is chunked when it arrives."""
    return chunk_documents(pages, size, overlap)


def history_stream(lines: DataFrame, invoices: DataFrame, as_of: Column) -> DataFrame:
    """Priced lines joined with their headers as they arrive."""
    header = invoices.select(
        F.col("id").alias("invoice_id"), F.coalesce("invoice_date", as_of).alias("invoice_date"),
        "currency",
    )
    priced = lines.filter((F.col("row_type") == "line_item") & (F.col("unit_price") > 0))
    return priced.join(header, "invoice_id").select(
        normalized_name(F.col("item_name")).alias("item_name_normalized"), "hs_code",
        "seller_name", "invoice_id", "invoice_date", "quantity", "unit_price", "currency",
    )


def stats_stream(history: DataFrame) -> DataFrame:
    """Price statistics kept current; run in update mode with keys `STATS_KEYS`."""
    return price_stats(history)


STATS_STREAM_KEYS = STATS_KEYS


def activity_stream(messages: DataFrame) -> DataFrame:
    """Time of the last message per session, kept current."""
    return messages.groupBy("session_id").agg(F.max("created_at").alias("last_message_at"))


LEDGER_FIELDS = (
    "item_id long, id long, movement_type string, quantity double, accepted boolean, "
    "applied_cost double, quantity_on_hand double, avg_cost double"
)


class LedgerProcessor(StatefulProcessor):
    """Quantity and mean cost per item, carried from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stock", "units long, mean double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, mean = self.state.get() if self.state.exists() else (0, 0.0)
        # One item's rows of one micro-batch; its size is set by the source options.
        batch = pd.concat(list(rows)).sort_values(["movement_time", "id"])
        out = []
        for r in batch.itertuples(index=False):
            units = round(r.quantity * UNIT)
            ok, booked, held, mean = step(r.movement_type, units, r.unit_cost, held, mean)
            out.append(
                (key[0], r.id, r.movement_type, r.quantity, ok, booked, held / UNIT, mean)
            )
        self.state.update((held, mean))
        names = [f.strip().split(" ")[0] for f in LEDGER_FIELDS.split(",")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def ledger_stream(movements: DataFrame) -> DataFrame:
    """Movements (item_id, id, movement_type, quantity, unit_cost, movement_time) as a ledger."""
    movements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return movements.groupBy("item_id").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(),
        outputStructType=LEDGER_FIELDS,
        outputMode="Append",
        timeMode="None",
    )


def low_stock_stream(ledger: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Accepted movements that leave an item at or below the threshold."""
    return ledger.filter(F.col("accepted") & (F.col("quantity_on_hand") <= threshold))


def repeat_purchase_stream(
    lines: DataFrame, history: DataFrame, window_days: int = 30, delay: str = "1 day"
) -> DataFrame:
    """Lines joined with the earlier days on which item and seller already occurred.

    Both inputs: name, seller, at (timestamp); lines also carry id. History is cut
    to one row per item, seller and day, so a line meets at most `window_days` rows.
    """
    earlier = (
        history.withWatermark("at", delay)
        .select("name", "seller", F.date_trunc("day", "at").alias("day"), "at")
        .dropDuplicatesWithinWatermark(["name", "seller", "day"])
        .select("name", "seller", F.col("day").alias("prior_day"), F.col("at").alias("prior_at"))
    )
    current = lines.withWatermark("at", delay).withColumn("line_day", F.date_trunc("day", "at"))
    interval = F.expr(f"INTERVAL {window_days} DAYS")
    return current.join(
        earlier,
        (current["name"] == earlier["name"])
        & (current["seller"] == earlier["seller"])
        & (F.col("prior_day") >= F.col("line_day") - interval)
        & (F.col("prior_day") < F.col("line_day"))
        & (F.col("prior_at") >= F.col("at") - F.expr(f"INTERVAL {window_days + 1} DAYS"))
        & (F.col("prior_at") <= F.col("at")),
    ).select("id", current["name"], current["seller"], "line_day", "prior_day")
