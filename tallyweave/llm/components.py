"""Connected components of an edge table: forests per task, then large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stash


#: Edges that one task contracts (16 bytes each); more edges mean more tasks.
EDGES_PER_TASK = 1_000_000


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links x-y."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, before[x])
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task become stars around the smallest nodes."""
    found = [b for b in batches if len(b)]
    if found:
        table = pa.Table.from_batches(found)
        a, b = np.asarray(table["a"]), np.asarray(table["b"])
        nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = nodes[forest(len(nodes), number[:len(a)], number[len(a):])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root < nodes]), pa.array(root[root < nodes])], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b). The minimum per node is a combinable aggregate that
    is joined back, so a node with very many neighbours stays a skewed join, not one group."""
    if large:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select(
        "n", F.least("n", "m").alias("m"))
    met = pairs.join(least, pairs.a == least.n)
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select("a", "b", "m").selectExpr("stack(2, a, m, b, m) as (a, b)")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of `edges` (a, b longs).

    Self loops and repeated edges do no harm; a node that only has a self loop is left out.
    Edges are dealt to tasks of bounded size, and each makes them stars around the smallest
    nodes it sees. One task's stars are the answer; those of several are joined by rounds of
    star steps, O(log^2 n) in theory and three or four for groups of copies. Each round is
    written to the shared checkpoint folder.
    """
    current = stash(edges.select("a", "b").where("a <> b"))
    tasks = max(1, -(-current.count() // EDGES_PER_TASK))
    current = stash(current.repartition(tasks).mapInArrow(_contract, "a long, b long"))
    seen = None
    while tasks > 1:
        row = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == seen:
            break
        seen = tuple(row)
        current = stash(_star(_star(current, True), False))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
