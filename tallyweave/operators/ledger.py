"""Stock ledger: running quantity and weighted-average cost with rejected issues.

Whether an issue is accepted depends on every movement before it, so the ledger is an
ordered fold per item. There is one path for every size: rows are cut into stretches of
about equal size along item and order, and an item may span many stretches. A stretch
needs two numbers to start from, quantity and mean cost. The quantities are guessed from
the stretches' sums as if nothing were rejected, all stretches are folded in parallel with
their guess, and those whose guess proves wrong are folded again from the right one. Each
round settles at least the next stretch of every item, so there are at most as many rounds
as an item has stretches, and one or two where rejects are rare. Given its start quantity,
a stretch changes the mean cost linearly, so mean costs are chained without another round.

Quantities are counted in millionths, so comparing them is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.session import cut_lineage

UNIT = 1_000_000
#: The kind of a row that sets an item's stock before its first movement.
OPENING = "\0opening"

_FOLDED = "accepted boolean, applied_cost double, quantity_on_hand double, avg_cost double"
_WORK = ["item_id", "movement_type", "_units", "unit_cost"]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(name).to_pylist() for name in _WORK))


def step(kind: str, units: int, cost: float, held: int, mean: float):
    """One movement: (accepted, cost it is booked at, quantity after, mean after)."""
    if kind == "in":
        after = held + units
        if after > 0:
            return True, cost, after, (held * mean + units * cost) / after
        return True, cost, after, cost
    if kind == "out" and held >= units:
        return True, mean, held - units, mean
    if kind == OPENING:
        return True, cost, units, cost
    return False, mean, held, mean


def fold_partition(
    batches: Iterator[pa.RecordBatch], keep: list[str], entry: tuple | None = None
) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by item and order. `entry` is (item, quantity, mean) to go on from."""
    item, held, mean = entry if entry else (None, 0, 0.0)
    for batch in batches:
        accepted, booked, quantity, average = [], [], [], []
        for key, kind, units, cost in _rows(batch):
            if key != item:
                item, held, mean = key, 0, 0.0
            ok, at, held, mean = step(kind, units, cost, held, mean)
            accepted.append(ok)
            booked.append(at)
            quantity.append(held / UNIT)
            average.append(mean)
        columns = [batch.column(name) for name in keep] + [
            pa.array(accepted, pa.bool_()),
            pa.array(booked, pa.float64()),
            pa.array(quantity, pa.float64()),
            pa.array(average, pa.float64()),
        ]
        names = keep + ["accepted", "applied_cost", "quantity_on_hand", "avg_cost"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _first_and_last(batches, first_step, last_step, last_reset):
    """Feed the rows of the first item to one callback and later items to another."""
    first = last = None
    for batch in batches:
        for key, kind, units, cost in _rows(batch):
            if first is None:
                first = last = key
            if key != last:
                last = key
                last_reset()
            if key == first:
                first_step(kind, units, cost)
            else:
                last_step(kind, units, cost)
    return first, last


def summarise(part: int, batches, held: int) -> dict | None:
    """A stretch whose first item starts with `held`: where it leads.

    `net` is the first item's sum without rejects, `held` its quantity afterwards, and its
    mean cost afterwards is scale * mean + offset. `tail` and `tail_mean` are the state of
    the last item if the stretch has several.
    """
    state = {"net": 0, "held": held, "scale": 1.0, "offset": 0.0, "tail": (0, 0.0)}

    def on_first(kind, units, cost):
        held = state["held"]
        if kind == "in":
            after = held + units
            keep, add = (held / after, units * cost / after) if after > 0 else (0.0, cost)
            state["scale"] *= keep
            state["offset"] = state["offset"] * keep + add
            state["held"] = after
            state["net"] += units
        elif kind == "out":
            state["net"] -= units
            if held >= units:
                state["held"] = held - units
        elif kind == OPENING:
            state.update(net=units, held=units, scale=0.0, offset=cost)

    def on_last(kind, units, cost):
        state["tail"] = step(kind, units, cost, *state["tail"])[2:]

    first, last = _first_and_last(
        batches, on_first, on_last, lambda: state.__setitem__("tail", (0, 0.0))
    )
    if first is None:
        return None
    tail, tail_mean = state.pop("tail")
    return {"part": part, "first_item": first, "last_item": last, "tail": tail,
            "tail_mean": tail_mean, **state}


def _parts(batches: Iterator[pa.RecordBatch]):
    """The number of the stretch that these batches are, and the batches."""
    first = next(batches, None)
    if first is None:
        return None, iter(())

    def again():
        yield first
        yield from batches

    return first.column("_part")[0].as_py(), again()


def _summaries(parts: DataFrame, starts: dict[int, int]) -> dict[int, dict]:
    """One row of a few numbers per stretch; their number is fixed by the caller."""
    item_type = dict(parts.dtypes)["item_id"]
    schema = (f"part int, first_item {item_type}, last_item {item_type}, net bigint, held bigint, "
              "scale double, offset double, tail bigint, tail_mean double")
    arrow = to_arrow_schema(parts.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        part, rows = _parts(batches)
        found = None if part is None else summarise(part, rows, starts.get(part, 0))
        if found is not None:
            yield pa.RecordBatch.from_pylist([found], schema=arrow)

    return {row["part"]: row.asDict() for row in parts.mapInArrow(run, schema).collect()}


def settled_starts(parts: DataFrame) -> dict[int, tuple]:
    """(first item, quantity, mean cost) that every stretch starts with."""
    found = _summaries(parts, {})
    tried = dict.fromkeys(found, 0)
    while True:
        wrong: dict[int, int] = {}
        starts: dict[int, int] = {}
        item, held = None, 0
        for part in sorted(found):
            s = found[part]
            starts[part] = held if s["first_item"] == item else 0
            if s["first_item"] != s["last_item"]:
                held = s["tail"]
            elif tried[part] == starts[part]:
                held = s["held"]
            else:
                wrong[part] = starts[part]
                held = max(0, starts[part] + s["net"])
            item = s["last_item"]
        if not wrong:
            break
        found.update(_summaries(parts.filter(F.col("_part").isin(list(wrong))), wrong))
        tried.update(wrong)
    entries: dict[int, tuple] = {}
    item, mean = None, 0.0
    for part in sorted(found):
        s = found[part]
        at_start = mean if s["first_item"] == item else 0.0
        entries[part] = (s["first_item"], starts[part], at_start)
        single = s["first_item"] == s["last_item"]
        mean = s["scale"] * at_start + s["offset"] if single else s["tail_mean"]
        item = s["last_item"]
    return entries


def stock_ledger(
    movements: DataFrame, order: list[str], stretches: int | None = None, opening: DataFrame | None = None
) -> DataFrame:
    """Every movement with its verdict, booked cost, quantity and mean cost after it.

    `movements`: item_id, movement_type (in, out), quantity, unit_cost and more columns
    that are passed through. `order` must be unique within an item. Rows are cut into
    `stretches` (the session's shuffle partitions if not given), written once to the
    checkpoint folder and folded a stretch per task; the driver holds a few numbers for
    each stretch. An item within one stretch has exactly the plain fold's numbers; where an
    item goes on in the next, its mean cost there may differ in the last bits.
    """
    keep = list(movements.columns)
    count = stretches or int(movements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order]
    work = movements.withColumn("_units", F.round(F.col("quantity") * UNIT).cast("long"))
    if opening is not None:
        first = opening.select("item_id", F.lit(OPENING).alias("movement_type"), F.col("units").alias("_units"),
                               F.col("mean").alias("unit_cost"), F.lit(0).alias("_turn"))
        work = work.withColumn("_turn", F.lit(1)).unionByName(first, allowMissingColumns=True)
        keys = [F.col("_turn"), *keys]
    parts = cut_lineage(
        work.repartitionByRange(count, F.col("item_id"), *keys)
        .sortWithinPartitions("item_id", *keys)
        .withColumn("_part", F.spark_partition_id())
    )
    entries = settled_starts(parts)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in movements.schema.fields]

    def run(batches):
        part, rows = _parts(batches)
        if part is not None:
            yield from fold_partition(rows, keep, entries[part])

    folded = parts.mapInArrow(run, ", ".join(fields) + ", " + _FOLDED)
    return folded if opening is None else folded.filter(~F.col("movement_type").eqNullSafe(OPENING))
