import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators.ledger import stock_ledger
from tallyweave.streaming import jobs
from tallyweave.streaming.late_ledger import FIELDS, LateLedger

SCHEMA = "item_id long, id long, movement_type string, quantity double, unit_cost double, movement_time string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("movement_time", F.to_timestamp("movement_time"))


def settled(ledger):
    rows = ledger.select("item_id", "id", "accepted", F.round("quantity_on_hand", 6).alias("q"), F.round("avg_cost", 6).alias("c"))
    return sorted(tuple(r) for r in rows.collect())


def shuffled(seed, n=900, hot=0.4):
    """Movements in order of arrival: up to two hours behind their own time, one item hot."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minute = rng.randrange(60 * 24 * 3)
        item = 1 if rng.random() < hot else rng.randrange(2, 30)
        time = f"2024-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00"
        rows.append((minute + rng.randrange(120), (item, i, rng.choice(["in", "out", "out", "count"]),
                                                   rng.randrange(1, 90) / 10, rng.randrange(1, 50) / 4, time)))
    return [r for _, r in sorted(rows)]


def test_shuffled_batches_equal_the_batch_ledger(spark, tmp_path):
    rows = shuffled(5)
    books = LateLedger(spark, str(tmp_path / "books"), delay_seconds=7200, compact=2, stretches=6)
    for number in range(6):
        batch = frame(spark, rows[number * 150:(number + 1) * 150])
        books.write_batch(batch, number)
        before = books.ledger().count()
        books.write_batch(batch, number)  # a replay
        assert books.ledger().count() == before
    assert books.late().count() == 0 and books.waiting().count() > 0
    books.close()
    books.close()
    want = stock_ledger(frame(spark, rows), ["movement_time", "id"], 1)
    assert settled(books.ledger()) == settled(want)
    assert books.waiting().count() == 0
    last = want.groupBy("item_id").agg(F.max_by(F.struct("quantity_on_hand", "avg_cost"), F.struct("movement_time", "id")).alias("s"))
    assert sorted((r.item_id, round(r.quantity_on_hand, 6), round(r.avg_cost, 6)) for r in books.balances().collect()) == sorted(
        (r.item_id, round(r.s.quantity_on_hand, 6), round(r.s.avg_cost, 6)) for r in last.collect())


def test_a_step_cut_short_is_repeated_from_the_same_stock(spark, tmp_path, monkeypatch):
    rows = shuffled(8, 300)
    books = LateLedger(spark, str(tmp_path / "books"), delay_seconds=7200, stretches=3)
    books.write_batch(frame(spark, rows[:150]), 0)
    before = settled(books.ledger())
    write = LateLedger._write

    def fails(self, rows, table, step):
        if table == "commits":
            raise RuntimeError("lost")
        write(self, rows, table, step)

    monkeypatch.setattr(LateLedger, "_write", fails)
    with pytest.raises(RuntimeError):
        books.write_batch(frame(spark, rows[150:]), 1)
    assert settled(books.ledger()) == before
    monkeypatch.setattr(LateLedger, "_write", write)
    books.write_batch(frame(spark, rows[150:]), 1)
    books.close()
    assert settled(books.ledger()) == settled(stock_ledger(frame(spark, rows), ["movement_time", "id"], 1))


def test_late_rows_and_rows_without_time_are_kept_apart(spark, tmp_path):
    books = LateLedger(spark, str(tmp_path / "books"), delay_seconds=3600)
    with pytest.raises(ValueError):
        books.ledger()
    books.write_batch(frame(spark, []), 0)
    assert books.ledger().count() == 0 and books.balances().count() == 0
    books.write_batch(frame(spark, [(1, 1, "in", 5.0, 2.0, "2024-01-01 10:00:00"), (1, 2, "in", 1.0, 2.0, None)]), 1)
    assert books.ledger().count() == 0 and books.waiting().count() == 1
    books.write_batch(frame(spark, [(2, 3, "in", 1.0, 1.0, "2024-01-01 12:00:00")]), 2)
    books.write_batch(frame(spark, [(1, 4, "out", 5.0, 0.0, "2024-01-01 09:00:00"),
                                    (1, 5, "out", 2.0, 0.0, "2024-01-01 11:30:00")]), 3)
    books.close()
    assert [r.id for r in books.late().orderBy("id").collect()] == [2, 4]
    assert settled(books.ledger()) == [(1, 1, True, 5.0, 2.0), (1, 5, True, 3.0, 2.0), (2, 3, True, 1.0, 1.0)]
    books.write_batch(frame(spark, [(1, 6, "out", 3.0, 0.0, "2024-01-02 09:00:00")]), 4)
    books.close()
    assert (1, 6, True, 0.0, 2.0) in settled(books.ledger())


def test_as_a_stream(spark, tmp_path):
    rows = shuffled(3, 200)
    path = str(tmp_path / "moves")
    for k in range(2):
        frame(spark, rows[k * 100:(k + 1) * 100]).coalesce(1).write.mode("append").parquet(path)
    schema = frame(spark, []).schema
    books = LateLedger(spark, str(tmp_path / "books"), delay_seconds=7200, stretches=2)
    books.follow(jobs.read_stream(spark, path, schema, files_per_batch=1), str(tmp_path / "state")).awaitTermination()
    books.close()
    assert books.ledger().columns[:6] == FIELDS
    assert settled(books.ledger()) == settled(stock_ledger(frame(spark, rows), ["movement_time", "id"], 1))
