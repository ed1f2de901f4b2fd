import random

from pyspark.sql import functions as F

from tallyweave.operators.ledger import stock_ledger
from tallyweave.streaming import jobs


def write_batches(df, path, parts, seed):
    """The rows in `parts` files, in order of `batch` or shuffled when it is NULL."""
    rows = df.collect()
    if seed is not None:
        random.Random(seed).shuffle(rows)
    size = -(-len(rows) // parts)
    spark = df.sparkSession
    for i in range(parts):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def movements(spark, sf):
    kind = F.col("event_type")
    return spark.read.parquet(f"{sf}/events.parquet").filter(kind.isin("signup", "view", "purchase")).select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("id"),
        F.when(kind == "purchase", "out").otherwise("in").alias("movement_type"),
        F.col("value").alias("quantity"), F.lit(2.0).alias("unit_cost"),
        F.col("ts").cast("timestamp").alias("movement_time")).orderBy("movement_time", "id")


def test_ledger_in_batches_equals_the_batch_ledger(spark, sf, tmp_path):
    path = str(tmp_path / "moves")
    source = movements(spark, sf)
    write_batches(source, path, 4, None)
    stream = jobs.read_stream(spark, path, source.schema, files_per_batch=1)
    got = jobs.drain_append(jobs.ledger_stream(stream)).select("id", "accepted", F.round("quantity_on_hand", 6))
    want = stock_ledger(source, ["movement_time", "id"]).select("id", "accepted", F.round("quantity_on_hand", 6))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    low = jobs.low_stock_stream(jobs.drain_append(jobs.ledger_stream(
        jobs.read_stream(spark, path, source.schema)))).count()
    assert low == want.filter("accepted AND `round(quantity_on_hand, 6)` <= 10").count()


def test_aggregates_take_rows_in_any_order(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))
    path = str(tmp_path / "messages")
    write_batches(source, path, 3, 7)
    stream = jobs.read_stream(spark, path, source.schema, files_per_batch=1)
    got = jobs.drain_update(jobs.activity_stream(stream), ["session_id"])
    want = source.groupBy("session_id").agg(F.max("created_at").alias("last_message_at"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_pages_are_indexed_once(spark, tmp_path):
    schema = "id long, doc_id long, page_no int, page_type string, text string"
    path, out, mark = (str(tmp_path / n) for n in ("pages", "chunks", "mark"))
    spark.createDataFrame([(1, 1, 1, "other", "One.")], schema).write.parquet(path)
    for text in (None, "Two."):
        if text:
            spark.createDataFrame([(2, 2, 1, "other", text)], schema).write.mode("append").parquet(path)
        stream = jobs.index_pages(jobs.read_stream(spark, path, schema))
        jobs.append_to(stream, out, mark).awaitTermination()
    assert sorted(r.chunk_text for r in spark.read.parquet(out).collect()) == ["One.", "Two."]


def test_repeat_purchases_ignore_late_rows_only(spark, tmp_path):
    schema = "id long, name string, seller string, at timestamp"
    days = ["2024-01-01 08:00:00", "2024-01-03 09:00:00", "2024-01-03 10:00:00", "2024-02-20 08:00:00"]
    rows = spark.createDataFrame([(i, "bolt", "ACME", d) for i, d in enumerate(days)],
                                 "id long, name string, seller string, at string").withColumn("at", F.to_timestamp("at"))
    path = str(tmp_path / "lines")
    write_batches(rows, path, 2, None)
    side = lambda: jobs.read_stream(spark, path, schema, files_per_batch=1)
    got = jobs.drain_append(jobs.repeat_purchase_stream(side(), side())).collect()
    assert sorted((r.id, str(r.prior_day.date())) for r in got) == [(1, "2024-01-01"), (2, "2024-01-01")]


def test_state_lies_on_disk(spark, tmp_path, monkeypatch):
    name, rows = "spark.sql.streaming.stateStore.providerClass", spark.range(50).select(
        (F.col("id") % 5).cast("string").alias("session_id"), F.col("id").alias("created_at"))
    write_batches(rows, str(tmp_path / "in"), 3, 1)
    monkeypatch.setattr(jobs, "work_folder", lambda _: str(tmp_path / "work"))
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
        got = jobs.drain_update(jobs.activity_stream(stream), ["session_id"], 2).collect()
        assert spark.conf.get(name).endswith("HDFSBackedStateStoreProvider")
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", None) is None
    finally:
        spark.conf.set(name, before)
    assert sorted(got) == [(str(k), 45 + k) for k in range(5)]
    state = [p.name for p in (tmp_path / "work/state/state").rglob("*") if p.is_file()]
    assert any(n.endswith((".changelog", ".zip")) for n in state) and not any(n.endswith(".delta") for n in state)
