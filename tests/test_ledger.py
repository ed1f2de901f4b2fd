import random

from pyspark.sql import functions as F

from tallyweave.operators import inventory
from tallyweave.operators.ledger import stock_ledger
from tallyweave.plans import model

SCHEMA = "item_id long, movement_type string, quantity double, unit_cost double, movement_date date, seq long"


def movements(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("movement_date date", "movement_date string")).withColumn(
        "movement_date", F.to_date("movement_date")
    )


def test_weighted_average(spark):
    rows = [
        (1, "in", 100.0, 10.0, "2024-01-01", 1),
        (1, "in", 50.0, 12.0, "2024-01-02", 2),
        (1, "out", 200.0, 0.0, "2024-01-03", 3),
        (1, "out", 150.0, 0.0, "2024-01-04", 4),
        (1, "out", 1.0, 0.0, "2024-01-05", 5),
        (1, "in", 4.0, 7.0, "2024-01-06", 6),
    ]
    got = stock_ledger(movements(spark, rows), ["movement_date", "seq"]).orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, True, False, True, False, True]
    assert [r.quantity_on_hand for r in got] == [100, 150, 150, 0, 0, 4]
    assert abs(got[1].avg_cost - 32 / 3) < 1e-9
    assert abs(got[3].applied_cost - 32 / 3) < 1e-9
    assert got[5].avg_cost == 7.0


def test_decimal_quantities_compare_exactly(spark):
    rows = [
        (1, "in", 0.1, 1.0, "2024-01-01", 1),
        (1, "in", 0.7, 1.0, "2024-01-02", 2),
        (1, "out", 0.8, 0.0, "2024-01-03", 3),
    ]
    got = stock_ledger(movements(spark, rows), ["movement_date", "seq"]).orderBy("seq").collect()
    assert got[2].accepted and got[2].quantity_on_hand == 0.0


def plain(rows):
    """seq -> (accepted, quantity) of rows (seq, kind, quantity), in order."""
    held, out = 0, {}
    for seq, kind, quantity in rows:
        accepted = kind == "in" or held >= quantity
        held += (quantity if kind == "in" else -quantity) * accepted
        out[seq] = (accepted, held)
    return out


def test_halving_issues_over_many_stretches(spark):
    """Issues whose acceptance depends on every bit of the quantity before them."""
    rng = random.Random(5)
    moves = []
    for _ in range(20):
        moves.append(("in", float(rng.randint(1, 2**19))))
        moves += [("out", float(2**k)) for k in range(18, -1, -1)]
        rng.random() < 0.5 and moves.append(("out", float(2**20)))
    rows = [(1, kind, q, 1.0, "2024-01-01", seq) for seq, (kind, q) in enumerate(moves)]
    got = stock_ledger(movements(spark, rows), ["seq"], stretches=23).collect()
    want = plain([(seq, kind, q) for seq, (kind, q) in enumerate(moves)])
    assert {r.seq: (r.accepted, r.quantity_on_hand) for r in got} == want
    assert 0 < sum(not a for a, _ in want.values()) < len(want)


def test_split_items_equal_the_plain_fold(spark, sf):
    """All movements moved onto three items, one of which holds most rows."""
    base = model.stock_movements(spark, sf).withColumn(
        "item_id", F.when(F.col("item_id") % 10 < 7, 0).otherwise(F.col("item_id") % 3)
    )
    order = ["movement_date", "seq"]
    columns = ["id", "accepted", "quantity_on_hand", F.round("avg_cost", 6), F.round("applied_cost", 6)]
    plain = stock_ledger(base, order, stretches=1).select(*columns)
    split = stock_ledger(base, order, stretches=40).select(*columns)
    assert plain.count() == base.count()
    assert plain.exceptAll(split).count() == 0
    assert split.exceptAll(plain).count() == 0
    assert split.filter("NOT accepted").count() > 0


def test_balance_without_rejects(spark):
    rows = [
        (1, "in", 5.0, 1.0, "2024-01-01", 1),
        (1, "out", 2.0, 1.0, "2024-01-01", 2),
        (1, "in", 4.0, 1.0, "2024-01-03", 3),
        (2, "out", 1.0, 1.0, "2024-01-02", 4),
    ]
    got = {r.seq: r.balance for r in inventory.stock_balance(movements(spark, rows), ["seq"]).collect()}
    assert got == {1: 5.0, 2: 3.0, 3: 7.0, 4: -1.0}
