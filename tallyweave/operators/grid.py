"""Compare every row of one table with every row of another in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_map(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    left_rows: int = 1_000,
    right_rows: int = 50_000,
    split_first: str = "right",
    left_count: int | None = None,
    right_count: int | None = None,
) -> DataFrame:
    """Run `compare` on every pair of a left block and a right block.

    The block counts follow from the row counts, so a task never sees more than
    about `left_rows` x `right_rows` rows, whatever the tables hold. Only what
    `compare` returns leaves the task; no pair rows are made. Rows of one key stay
    together; where a key has several rows, give the number of keys as the count.
    With less than three blocks per core, the `split_first` side is cut finer.
    """
    session = left.sparkSession
    wanted = 3 * session.sparkContext.defaultParallelism
    n_left = max(1, math.ceil((left.count() if left_count is None else left_count) / left_rows))
    n_right = max(1, math.ceil((right.count() if right_count is None else right_count) / right_rows))
    if n_left * n_right < wanted:
        if split_first == "right":
            n_right = math.ceil(wanted / n_left)
        else:
            n_left = math.ceil(wanted / n_right)
    # A given number keeps adaptive execution from merging small but slow blocks.
    tasks = min(n_left * n_right, max(wanted, int(session.conf.get("spark.sql.shuffle.partitions"))))

    def blocks(key: str, count: int):
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left_cells = left.withColumn("_lb", blocks(left_key, n_left)).withColumn("_rb", every(n_right))
    right_cells = right.withColumn("_rb", blocks(right_key, n_right)).withColumn(
        "_lb", every(n_left)
    )
    return (
        left_cells.repartition(tasks, "_lb", "_rb")
        .groupBy("_lb", "_rb")
        .cogroup(right_cells.repartition(tasks, "_lb", "_rb").groupBy("_lb", "_rb"))
        .applyInArrow(compare, schema)
    )
