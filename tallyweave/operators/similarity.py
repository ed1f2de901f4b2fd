"""Similarity of short names: exact search for all partners above a ratio.

The ratio is the one of difflib. Bounds that never fall below it decide which pairs
are worth computing. Names are put into classes by their length and by how many
characters of four kinds they hold; only classes whose bound reaches the threshold
meet. Inside a block, array arithmetic over all its names bounds every pair by the
shared characters and by the longest common subsequence.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS = 64
#: Kinds of characters that classes count; all others are the fourth kind.
KINDS = ("aeiou", "lnrst", "0123456789 ")
#: Names and texts of a block, about.
BLOCK_NAMES, BLOCK_TEXTS = 500, 2_000
#: Names of at most so many characters fit the words of the subsequence bound.
WORD = 64


def _profiles(names: list[str]) -> np.ndarray:
    """Character counts per name. Sharing a bucket only ever raises the bound."""
    out = np.zeros((len(names), BUCKETS), dtype=np.int32)
    for i, name in enumerate(names):
        for char in name:
            out[i, ord(char) % BUCKETS] += 1
    return out


class TextBlock:
    """Distinct texts prepared for repeated comparison."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.profiles = _profiles(texts)
        self.sizes = np.array([len(t) for t in texts])
        self.matchers: dict[int, SequenceMatcher] = {}
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters, codes = np.unique(points, return_inverse=True)
        self.codes = codes.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]

    def bounds(self, name: str, threshold: float = 0.0) -> np.ndarray:
        """No ratio of `name` with a text exceeds its bound.

        Texts whose shared characters reach the threshold get the closer bound.
        """
        total = np.maximum(self.sizes + len(name), 1)
        shared = np.minimum(self.profiles, _profiles([name])).sum(axis=1)
        if 0 < len(name) <= WORD:
            close = np.flatnonzero(2 * shared / total >= threshold)
            shared[close] = np.minimum(shared[close], self.common(name, close))
        return 2 * shared / total

    def common(self, name: str, at: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of `name` and each text in `at`.

        A text holds a word of one bit per character of the name; a bit turns to 0
        where the subsequence grows. All texts take their next character together.
        """
        masks = np.zeros(len(self.letters), np.uint64)
        for i, char in enumerate(name):
            spot = np.searchsorted(self.letters, ord(char))
            if spot < len(self.letters) and self.letters[spot] == ord(char):
                masks[spot] |= np.uint64(1 << i)
        order = at[np.argsort(-self.sizes[at], kind="stable")]
        sizes, starts = self.sizes[order], self.starts[order]
        words = np.full(len(order), np.iinfo(np.uint64).max, np.uint64)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -j, side="left"))
            word = words[:live]
            hit = word & masks[self.codes[starts[:live] + j]]
            words[:live] = (word + hit) | (word - hit)
        found = np.zeros(len(self.texts), np.int64)
        found[order] = np.bitwise_count(~words & np.uint64((1 << len(name)) - 1))
        return found[at]

    def ratio(self, name: str, at: int) -> float:
        matcher = self.matchers.get(at)
        if matcher is None:
            matcher = self.matchers[at] = SequenceMatcher()
            matcher.set_seq2(self.texts[at])
        matcher.set_seq1(name)
        return matcher.ratio()

    def best(
        self, name: str, owners: list[list[tuple]], threshold: float, keep: int,
        digits: int | None,
    ) -> list[tuple]:
        """The `keep` best owners of texts: (owner, score), equal scores by owner.

        Texts are tried in order of their bounds; the search ends when no bound
        reaches the weakest score kept.
        """

        def shown(x: float) -> float:
            return x if digits is None else round(x, digits)

        bounds = self.bounds(name, threshold)
        found: dict[tuple, float] = {}
        weakest = -1.0
        for at in np.argsort(-bounds, kind="stable").tolist():
            if bounds[at] < threshold or shown(float(bounds[at])) < weakest:
                break
            if not owners[at]:
                continue
            ratio = self.ratio(name, at)
            if ratio < threshold:
                continue
            for owner in owners[at]:
                if shown(ratio) > found.get(owner, -1.0):
                    found[owner] = shown(ratio)
            if len(found) >= keep:
                weakest = nlargest(keep, found.values())[-1]
        return sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:keep]


def _classed(df: DataFrame, text: str) -> DataFrame:
    """`df` with its length, its counts of every kind of character and its class."""

    def step(n: Column) -> Column:
        return F.floor(2 * F.log2(n + 1)).cast("int")

    size = F.length(text)
    counts = [size - F.length(F.translate(text, kind, "")) for kind in KINDS]
    rest = size
    for count in counts:
        rest = rest - count
    return (
        df.withColumn("_size", size)
        .withColumn("_counts", F.array(*counts, rest))
        .withColumn("_band", step(F.col("_size")))
        .withColumn("_class", F.concat_ws(
            ".", F.col("_band"), *[step(F.col("_counts")[i]) for i in range(len(KINDS) + 1)]))
    )


def _classes(classed: DataFrame) -> DataFrame:
    """One row per class: rows, least and greatest length, greatest count of every kind."""
    return classed.groupBy("_class", "_band").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_size").alias("low"), F.max("_size").alias("high"),
        F.array(*[F.max(F.col("_counts")[i]) for i in range(len(KINDS) + 1)]).alias("most"),
    )


def meeting_classes(names: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(name_class, text_class, names, texts) of classes that may hold a pair above the ratio.

    Both inputs come from `_classed`. The ratio is at most 2 min(a, b) / (a + b) by the
    lengths, so a class looks at some bands of lengths only; among these, the characters
    that two classes can share at most decide. The work follows from the number of classes.
    """
    least = max(threshold, 0.01)
    share = least / (2 - least)

    def step(n: Column) -> Column:
        return F.floor(2 * F.log2(n + 1)).cast("int")

    left = _classes(names).select(
        F.col("_class").alias("name_class"), F.col("rows").alias("names"),
        F.col("low").alias("a_low"), F.col("most").alias("a_most"),
        F.explode(F.sequence(step(F.floor(F.col("low") * share)),
                             step(F.ceil(F.col("high") / share)))).alias("_band"),
    )
    right = _classes(texts).select(
        "_band", F.col("_class").alias("text_class"), F.col("rows").alias("texts"),
        F.col("low").alias("b_low"), F.col("most").alias("b_most"),
    )
    shared = sum(
        (F.least(F.col("a_most")[i], F.col("b_most")[i]) for i in range(len(KINDS) + 1)), F.lit(0)
    )
    return (
        left.join(right, "_band")
        .filter(2 * shared + 1e-6 >= threshold * (F.col("a_low") + F.col("b_low")))
        .select("name_class", "text_class", "names", "texts")
    )


def compared_pairs(names: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(compared, possible): pairs of names (name) and texts (text) that meet, and all pairs."""
    left, right = _classed(names, "name"), _classed(texts, "text")
    met = meeting_classes(left, right, threshold).agg(
        F.coalesce(F.sum(F.col("names") * F.col("texts")), F.lit(0)).alias("compared"))
    sizes = left.agg(F.count(F.lit(1)).alias("a")).join(right.agg(F.count(F.lit(1)).alias("b")))
    return met.join(sizes.select((F.col("a") * F.col("b")).alias("possible")))


def similar_materials(
    queries: DataFrame,
    texts: DataFrame,
    threshold: float,
    keep: int,
    ordered: bool = False,
    round_first: bool = True,
) -> DataFrame:
    """The `keep` most similar materials per query name.

    `queries`: name (unique) and, when `ordered`, seq. `texts`: text_id (unique),
    text, material_id, material_name and, when `ordered`, seq (NULL: always there);
    then only texts of a smaller seq count. Result: name, material_id,
    material_name, score; ties go to the smaller material name, then id. With
    `round_first` scores are compared as rounded to 4 digits.
    """
    schema = "name string, material_id string, material_name string, score double"
    arrow = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        names = left.column("name").to_pylist()
        text = right.column("text").to_pylist()
        ids = right.column("material_id").to_pylist()
        shown = right.column("material_name").to_pylist()
        left_seq = left.column("seq").to_pylist() if ordered else None
        right_seq = right.column("seq").to_pylist() if ordered else None
        distinct: dict[str, list[int]] = {}
        for j, value in enumerate(text):
            distinct.setdefault(value, []).append(j)
        block = TextBlock(list(distinct))
        members = list(distinct.values())

        def owners(i: int) -> list[list[tuple]]:
            """Materials per text, as (name, id), that name `i` may be compared with."""
            if not ordered:
                return always
            return [
                [(shown[j], ids[j]) for j in group
                 if right_seq[j] is None or right_seq[j] < left_seq[i]]
                for group in members
            ]

        always = [[(shown[j], ids[j]) for j in group] for group in members]
        digits = 4 if round_first else None
        rows = []
        for i, name in enumerate(names):
            for owner, score in block.best(name, owners(i), threshold, keep, digits):
                rows.append((name, owner[1], owner[0], score))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table([list(c) for c in columns], schema=arrow)

    left, right = _classed(queries, "name"), _classed(texts, "text")
    meets = meeting_classes(left, right, threshold)
    # Every class of names is cut into parts, and the texts that it meets into shards.
    blocks = meets.groupBy("name_class").agg(
        F.ceil(F.max("names") / BLOCK_NAMES).cast("int").alias("_parts"),
        F.ceil(F.sum("texts") / BLOCK_TEXTS).cast("int").alias("_shards"),
    )
    cell = ["_cell_class", "_part", "_shard"]
    shape = blocks.withColumnRenamed("name_class", "_cell_class")

    def one_of(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    asked = (
        left.withColumnRenamed("_class", "_cell_class").join(shape, "_cell_class")
        .withColumn("_part", one_of("name", "_parts")).withColumn("_shard", each("_shards"))
        .select(*queries.columns, *cell)
    )
    offered = (
        right.join(
            meets.select(F.col("name_class").alias("_cell_class"), F.col("text_class").alias("_class"))
            .join(shape, "_cell_class"), "_class")
        .withColumn("_shard", one_of("text_id", "_shards")).withColumn("_part", each("_parts"))
        .select(*texts.columns, *cell)
    )
    # A given number keeps adaptive execution from merging small but slow blocks.
    session = queries.sparkSession
    tasks = max(3 * session.sparkContext.defaultParallelism,
                int(session.conf.get("spark.sql.shuffle.partitions")))
    found = (
        asked.repartition(tasks, *cell).groupBy(*cell)
        .cogroup(offered.repartition(tasks, *cell).groupBy(*cell))
        .applyInArrow(compare, schema)
    )
    # Texts of one material may lie in several blocks.
    return found.groupBy("name", "material_id", "material_name").agg(F.max("score").alias("score"))
