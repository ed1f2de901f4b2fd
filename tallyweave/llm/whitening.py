"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stash
from tallyweave.llm.vectors import EXACT, add_up, column_sums, exact_ints, floors, matrix, usable_rows

FACTOR, COMPONENTS = 256, 4
#: A singular triplet has converged when its residual is below this share of the largest value.
TOLERANCE = 1e-15
#: Directions weaker than this share of the trace are rounding, not data.
FLAT = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n and exact sums of the fit list, components (columns) with eigenvalues, trace of the
    covariance, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    steps: int


def centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact n x - S where it fits."""
    top = float(np.abs(whole).max(initial=0.0)) * n + max(map(abs, sums), default=0)
    if top < EXACT:
        return (whole * n - np.array(sums, np.float64)) / n
    return np.array([[(n * x - s) / n for x, s in zip(row, sums)] for row in exact_ints(whole).tolist()],
                    np.float64).reshape(whole.shape)


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    top = float(np.abs(whole).max(initial=0.0)) * n + max(map(abs, sums), default=0)
    if top * top * max(1, whole.shape[1]) < 2.0 ** 62:
        apart = whole.astype(np.int64) * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    totals = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in exact_ints(whole).tolist()]
    return [t if t < 2 ** 63 else None for t in totals]


def fit_list(rows: DataFrame, dim: int, vector_col: str) -> DataFrame:
    """Each distinct whole vector floor(256 c) once, as doubles (whole numbers), written."""
    floored = F.transform(F.col(f"`{vector_col}`"), lambda c: F.expr("0D") + _floor(c))
    return stash(rows.select(floored.alias("vector")).distinct())


def _floor(c):
    """floor(256 c) as a double, also where it fits no long; plus zero turns -0 into 0."""
    scaled = c.cast("double") * FACTOR
    return F.when(F.abs(scaled) < float(2 ** 62), F.floor(scaled).cast("double")).otherwise(scaled)


def _total(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, column_sums(matrix(batch.column("vector"), dim)))]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()),
                                          pa.array([[str(x) for x in sums]], pa.list_(pa.string()))], ["k", "n", "sums"])

    row = add_up(fit.mapInArrow(run, "k int, n long, sums array<string>"), ["k"]).first()
    return (row["n"], [int(x) for x in row["sums"]]) if row else (0, [0] * dim)


def _product(fit: DataFrame, dim: int, n: int, sums: list[int], columns: np.ndarray) -> np.ndarray:
    """X^T (X columns) and columns^T X^T X columns below it, over the centred rows X.

    One pass: every task multiplies its rows with the columns, and that with its rows; the
    partial products, one row per task and entry, are added up by Spark.
    """
    width = columns.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + width, width))
        for batch in batches:
            x = centred(matrix(batch.column("vector"), dim), n, sums)
            u = x @ columns
            total += np.concatenate((x.T @ u, u.T @ u))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])

    out = np.zeros((dim + width) * width)
    for r in fit.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(dim + width, width)


def bidiagonalise(fit: DataFrame, dim: int, n: int, sums: list[int], wanted: int = COMPONENTS,
                  locked: np.ndarray | None = None, below: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right singular vectors as columns, steps) of the centred rows X.

    Golub-Kahan-Lanczos: alpha_k u_k = X v_k - beta u_(k-1), beta v_(k+1) = X^T u_k - alpha_k v_k.
    A left vector has an entry per row of the fit list. It always is X w for a short w, so
    tasks compute their entries of X v and of the left vectors anew from the rows they read,
    and the left vectors stay where the rows are. One pass gives X^T X v, from which X^T u_k
    and the products with all earlier left vectors follow; both sides are orthogonalised
    against all vectors before, the right side twice and against the columns `locked`.

    A vanishing vector means an invariant space: the next right vector is a random one beside
    it, and if X takes that to nothing, the rows have no more directions. It ends there, when
    the space is exhausted, when the wanted triplets have residuals below TOLERANCE, or when
    the largest value is sure to stay under `below`.
    """
    rng = np.random.default_rng(13)
    locked = np.empty((dim, 0)) if locked is None else locked
    right, w_left, xt_left, alpha, beta = [], [], [], [], []  # v_k, w_k with u_k = X w_k, X^T u_k
    values, vectors, largest = np.empty(0), np.empty((dim, 0)), 1e-300

    def beside(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - locked @ (locked.T @ v)
            if right:
                v = v - np.array(right).T @ (np.array(right) @ v)
        return v

    room = dim - locked.shape[1]
    new = beside(rng.standard_normal(dim)) if room else None
    fresh = True
    while room and len(right) < room:
        right.append(new / np.linalg.norm(new))
        q = _product(fit, dim, n, sums, right[-1][:, None])[:dim, 0]  # X^T (X v_k)
        p, image = right[-1].copy(), q.copy()                       # X p is the new left vector
        if w_left:
            against = np.array(w_left) @ q                           # u_j . X v_k, for all j
            p -= against @ np.array(w_left)
            image -= against @ np.array(xt_left)
        size = float(np.sqrt(max(p @ image, 0.0)))                   # |X p|
        largest = max(largest, size)
        gone = size <= 1e-13 * largest
        if gone and fresh:
            right.pop()
            beta = beta[:-1]
            break
        alpha.append(0.0 if gone else size)
        w_left.append(p * 0 if gone else p / size)
        xt_left.append(image * 0 if gone else image / size)
        left, values, right_t = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        vectors = np.array(right).T @ right_t.T
        new = beside(xt_left[-1] - alpha[-1] * right[-1])
        rest = float(np.linalg.norm(new))
        residual = rest * np.abs(left[-1, :wanted])
        if values[0] + residual[0] < below or (
                len(alpha) >= wanted and rest > 1e-13 * largest and (residual <= TOLERANCE * values[0]).all()):
            break
        fresh = rest <= 1e-13 * largest
        if fresh and len(right) < room:
            new = beside(rng.standard_normal(dim))
        beta.append(0.0 if fresh else rest)
    return values, vectors, len(alpha)


def fit_whitening(rows: DataFrame, dim: int, vector_col: str = "embedding", wanted: int = COMPONENTS) -> Whitening:
    """Components of the distinct whole vectors of `rows`, all of length `dim`.

    One start finds a direction of each eigenvalue only, so what was found is locked and the
    rest of the space searched again until nothing there is as strong as the last component.
    """
    fit = fit_list(rows, dim, vector_col)
    n, sums = _total(fit, dim)
    if not n:
        return Whitening(0, sums, np.empty((dim, 0)), np.empty(0), 0.0, 0.0, 0)
    found, basis, steps = bidiagonalise(fit, dim, n, sums, wanted)
    take = basis[:, :wanted]
    while len(found) and steps < dim and take.shape[1] < dim:
        least = np.sort(found)[::-1][:wanted][-1] if len(found) >= wanted else 0.0
        more, basis, extra = bidiagonalise(fit, dim, n, sums, 1, take, least)
        steps += extra
        if not len(more) or more[0] < least:
            break
        found, take = np.concatenate((found[:take.shape[1]], more[:1])), np.hstack((take, basis[:, :1]))
    # One more pass with the columns found: their products give eigenvalues to full precision,
    # and the small rotation that leaves them exactly uncorrelated.
    take = np.linalg.qr(take)[0] if take.shape[1] else take
    gram = _product(fit, dim, n, sums, take)[dim:] / n if take.shape[1] else np.empty((0, 0))
    values, turn = np.linalg.eigh((gram + gram.T) / 2) if len(gram) else (np.empty(0), np.empty((0, 0)))
    order = np.argsort(-values, kind="stable")
    components = take @ turn[:, order]
    trace = _trace(fit, dim, n, sums)
    keep = [i for i in range(min(wanted, len(order))) if values[order][i] > FLAT * trace]
    components, values = components[:, keep], values[order][keep]
    scaled = components / np.sqrt(values)
    error = np.abs(_product(fit, dim, n, sums, scaled)[dim:] / n - np.eye(len(keep))).max() if keep else 0.0
    return Whitening(n, sums, components, values, trace, float(error), steps)


def _trace(fit: DataFrame, dim: int, n: int, sums: list[int]) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = centred(matrix(batch.column("vector"), dim), n, sums)
            total += float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["value"])

    return float(fit.mapInArrow(run, "value double").agg(F.sum("value")).first()[0] or 0.0) / n


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           wanted: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold a null or non-finite entry are dropped, and so are
    those whose length is not the most frequent one. Entries become x = floor(256 c). The fit
    list holds each distinct x once; covariances are over it. Components without variance are
    left out, so constant vectors or a single one give no rows, and short vectors fewer than
    `wanted` components. A deviation beyond a long is null. Repeated rows are answered each.

    The driver holds vectors of the length of a row, never one of the length of the table; a
    pass over the fit list costs a task its rows and sends one partial product.
    """
    good, dim = usable_rows(rows, vector_col)
    model = fit_whitening(good, dim, vector_col, wanted)
    narrow = good.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    scaled, explained = model.components / np.sqrt(model.values), model.values / (model.trace or 1.0)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            whole = floors(matrix(batch.column("vector"), dim), FACTOR)
            z = centred(whole, model.n, model.sums) @ scaled
            rows_of = np.repeat(np.arange(len(whole)), k)
            apart = pa.array(deviations(whole, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(whole))),
                 apart.take(pa.array(rows_of)), pa.array(z.ravel()), pa.array(np.tile(explained, len(whole)))],
                ["id", "component", "deviation", "whitened", "explained"])

    kinds = dict(narrow.dtypes)
    out = narrow.mapInArrow(run, f"id {kinds['id']}, component int, deviation long, whitened double, explained double")
    return out.select("id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
                      F.lit(model.identity_error).alias("identity_error"))


def whitening_query(rows: DataFrame) -> DataFrame:
    return whiten(rows).withColumnRenamed("id", "vec_id")
