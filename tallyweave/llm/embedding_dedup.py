"""Embedding near-dedup: int8 tile products with error bounds, full precision where needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stash
from tallyweave.llm.components import components, forest

#: Vectors of one block on average; a tile compares two blocks.
BLOCK = 2048
_STRIP = 256


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 codes, scales, and the length of what the codes leave out."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return unit, codes, scale, np.sqrt((rest * rest).sum(axis=1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in a, in b) of all pairs with cosine >= threshold.

    With u = s q + e for each unit vector, |u.v - s s' (q.q')| <= |e| + (1 + |e|) |e'|. Products
    of codes are whole numbers, exact in float32 up to 1,000 dimensions and computed in
    float64 beyond. Pairs that the bound leaves possible are computed anew in double precision.
    """
    unit_a, codes_a, scale_a, rest_a = quantise(a)
    unit_b, codes_b, scale_b, rest_b = quantise(b)
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    right = codes_b.astype(kind).T
    slack_b = float(rest_b.max()) if len(b) else 0.0
    rows, cols = [], []
    for start in range(0, len(a), _STRIP):
        part = slice(start, start + _STRIP)
        product = codes_a[part].astype(kind) @ right
        product *= scale_b.astype(kind)
        least = (threshold - 1e-5 - rest_a[part] - (1 + rest_a[part]) * slack_b) / scale_a[part]
        i, j = np.nonzero(product >= (least - 1e-5 * np.abs(least))[:, None].astype(kind))
        for k in range(0, len(i), 1 << 16):
            x, y = i[k:k + (1 << 16)] + start, j[k:k + (1 << 16)]
            near = codes_product(codes_a, codes_b, scale_a, scale_b, x, y)
            possible = near + rest_a[x] + (1 + rest_a[x]) * rest_b[y] + 1e-9 >= threshold
            x, y = x[possible], y[possible]
            linked = np.einsum("ij,ij->i", unit_a[x], unit_b[y]) >= threshold
            rows.append(x[linked])
            cols.append(y[linked])
    return (np.concatenate(rows) if rows else np.empty(0, np.int64),
            np.concatenate(cols) if cols else np.empty(0, np.int64))


def codes_product(codes_a, codes_b, scale_a, scale_b, x, y) -> np.ndarray:
    return np.einsum("ij,ij->i", codes_a[x].astype(np.int64), codes_b[y].astype(np.int64)) * scale_a[x] * scale_b[y]


def embedding_classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct usable vectors: (class_id, vector, rep, copies). rep is the least id."""
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    return stash(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn(
        "class_id", F.monotonically_increasing_id()))


def link_tiles(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n): rows with b tell that class a reaches class b; rows without, that class a
    is linked with n vectors of other classes. Each tile gives at most one edge per node."""
    blocks = max(1, -(-classes.count() // block))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "class_id", "copies", "vector", "block", F.size("vector").alias("dim"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        ids, copies = np.asarray(table["class_id"]), np.asarray(table["copies"])
        flat = np.asarray(table["vector"].combine_chunks().flatten()).astype(np.float64)
        values = flat.reshape(len(ids), -1)
        side = np.asarray(table["block"])
        first = np.flatnonzero(side == low)
        second = first if low == high else np.flatnonzero(side == high)
        x, y = tile_links(values[first], values[second], threshold) if len(second) and len(first) else ([], [])
        x, y = first[x] if len(x) else np.empty(0, np.int64), second[y] if len(y) else np.empty(0, np.int64)
        if low == high:
            both = x < y
            x, y = x[both], y[both]
        n = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
        label = forest(len(ids), x, y)
        linked, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({
            "a": pa.array(np.concatenate((ids[linked], ids[moved]))),
            "b": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(ids[label[moved]])]),
            "n": pa.concat_arrays([pa.array(n[linked].astype(np.int64)), pa.nulls(len(moved), pa.int64())])})

    return cells.groupBy("low", "high", "dim").applyInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK,
                           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    Two rows link when their cosine is at least `threshold` (0 < threshold <= 1); vectors of
    different lengths never do. Null or zero vectors, and those with null or non-finite
    parts, link with nothing and are their own component. Equal vectors form one class and
    link with each other; rows that repeat an id count each. component_id is the least id
    reachable, kept tells whether a row has it; a null id is never kept.

    Work grows with the square of the distinct vectors; every pair of blocks is a tile of
    bounded size in a task of its own, which returns link counts and a spanning forest, never
    the pairs. A block meets the others by being sent to each of them.
    """
    classes = embedding_classes(vectors, id_col, vector_col)
    found = stash(link_tiles(classes, threshold, block))
    counts = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    parts = components(found.where("b is not null").select("a", "b"))
    named = classes.select("class_id", "rep", "copies", *_keys("vector")).join(
        parts.withColumnRenamed("node", "class_id"), "class_id", "left").join(counts, "class_id", "left").select(
        F.coalesce("component", "class_id").alias("component"), "rep", "h1", "h2",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("h1", "h2", "n", "least")
    rows = vectors.select(F.col(id_col).alias("id"), *_keys(vector_col))
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.coalesce("least", "id")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _keys(column: str):
    """Two fingerprints of a vector; -0.0 and 0.0 agree, as they do in grouping."""
    plain = F.transform(F.col(f"`{column}`"), lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))
    return (F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("second"), plain).alias("h2"))


def embedding_query(vectors: DataFrame) -> DataFrame:
    return near_duplicate_vectors(vectors).withColumnRenamed("id", "vec_id")
