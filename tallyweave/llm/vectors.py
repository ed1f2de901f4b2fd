"""Whole-number vectors: usable rows, floors, and exact integer sums of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products and sums of whole numbers below this are exact in doubles.
EXACT = 2.0 ** 53


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds no null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))), F.lit(False))


def usable_rows(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Usable rows with vectors of the most frequent length (the shorter at ties), and that length."""
    good = rows.where(usable(F.col(f"`{vector_col}`")) & (F.size(F.col(f"`{vector_col}`")) > 0))
    size = F.size(F.col(f"`{vector_col}`"))
    most = good.groupBy(size.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = most["d"] if most else 0
    return good.where(size == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), dim)


def floors(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * value): whole doubles, exact as `factor` is a power of two."""
    return np.floor(values * float(factor)) + 0.0


def exact_ints(whole: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers of any size."""
    return np.array([int(x) for x in whole.ravel()], dtype=object).reshape(whole.shape)


def column_sums(whole: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole doubles."""
    top = float(np.abs(whole).max()) if whole.size else 0.0
    if top * len(whole) < 2.0 ** 62:
        return [int(x) for x in whole.astype(np.int64).sum(axis=0)]
    return [sum(column) for column in zip(*exact_ints(whole).tolist())] if len(whole) else [0] * whole.shape[1]


def add_up(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the count `n` and the whole numbers in `sums` (decimal text, any size) of equal keys.

    Rows are one per task and key; they are merged per key in a streamed fold.
    """
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            count += sum(batch.column("n").to_pylist())
            for row in batch.column("sums").to_pylist():
                values = [int(x) for x in row]
                total = values if total is None else [a + b for a, b in zip(total, values)]
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([count], pa.int64()),
                                          pa.array([[str(x) for x in total or []]], pa.list_(pa.string()))],
                                         [*keys, "n", "sums"])

    schema = ", ".join([*(f"{k} int" for k in keys), "n long", "sums array<string>"])
    return partial.groupBy(*keys).applyInArrow(run, schema)
