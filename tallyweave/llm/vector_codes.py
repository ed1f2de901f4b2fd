"""Vector codes: product codebooks of whole numbers, searched through a GNAT of their entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stash
from tallyweave.llm.vectors import EXACT, add_up, column_sums, exact_ints, floors, matrix, usable_rows

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Split points of a node, and entries under which a node is a plain list.
SPLITS, LEAF = 6, 10
#: Vectors that are looked up side by side.
_STRIP = 4096
#: Distances are doubles of relative error below 2^-50; ranges and radii are widened by this.
_SLACK = 2.0 ** -48


@dataclass
class Node:
    """Entries of a subtree: split points, each with a child, and the ranges of distances from
    split i to all entries under child j (its split point included)."""

    splits: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows: doubles where all terms stay below 2^53,
    Python integers beyond."""
    if a.dtype != object and b.dtype != object:
        top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
        if 4 * a.shape[1] * top * top < EXACT:
            return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    a, b = (x if x.dtype == object else exact_ints(x) for x in (a, b))
    return np.array([[sum((p - q) ** 2 for p, q in zip(x, y)) for y in b.tolist()] for x in a.tolist()],
                    dtype=object).reshape(len(a), len(b))


def _roots(squares: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(squares.astype(np.float64))


def build(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """GNAT over the rows `members` of `entries`; split points are spread by farthest-first choice."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    distance = _roots(squared(entries[members], entries[members]))
    chosen = [int(distance.sum(axis=1).argmax())]
    while len(chosen) < SPLITS:
        chosen.append(int(distance[:, chosen].min(axis=1).argmax()))
    chosen = list(dict.fromkeys(chosen))  # repeated entries leave fewer split points
    owner = distance[:, chosen].argmin(axis=1)
    owner[chosen] = np.arange(len(chosen))
    node = Node(members[chosen], [], np.empty((len(chosen), len(chosen))), np.empty((len(chosen), len(chosen))))
    rest = np.ones(len(members), bool)
    rest[chosen] = False
    for j in range(len(chosen)):
        under = owner == j
        reach = distance[:, chosen][under]
        node.low[:, j], node.high[:, j] = reach.min(axis=0) * (1 - _SLACK), reach.max(axis=0) * (1 + _SLACK)
        own = members[under & rest]
        if len(own) == len(members):  # cannot happen with a split point taken out; guards the recursion
            raise AssertionError("a split point must leave its node")
        node.children.append(build(entries, own) if len(own) else None)
    return node


class Search:
    """Nearest entries of many queries at once: smallest (squared distance, entry number)."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root, self.compared = entries, build(entries), 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry numbers, exact squared distances).

        A greedy way down gives each query a radius. The full traversal then leaves out a child
        only if, for some split point, every entry under the child is strictly farther than
        the radius by the triangle inequality; distances, ranges and radii are rounded so
        that they leave out less. All decisions between entries compare exact whole numbers,
        ties go to the lower number.
        """
        found = [self._strip(queries[i:i + _STRIP]) for i in range(0, len(queries), _STRIP)]
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _strip(self, queries):
        best, best_square = np.full(len(queries), len(self.entries)), None
        state = [best, best_square]
        self._descend(self.root, queries, np.arange(len(queries)), state)
        self._visit(self.root, queries, np.arange(len(queries)), state)
        return state[0], state[1]

    def _offer(self, points, queries, active, state) -> np.ndarray:
        """Take the points of a node into account; returns their exact squared distances."""
        squares = squared(queries[active], self.entries[points])
        self.compared += squares.size
        order = np.argsort(points, kind="stable")
        at = order[squares[:, order].argmin(axis=1)]  # the lowest number among equal distances
        least, number = squares[np.arange(len(active)), at], points[at]
        if state[1] is None:
            state[1] = np.full(len(queries), np.inf, dtype=squares.dtype)
        if squares.dtype == object and state[1].dtype != object:
            state[1] = np.array([x if x == np.inf else int(x) for x in state[1]], dtype=object)
        known, known_number = state[1][active], state[0][active]
        better = (least < known) | ((least == known) & (number < known_number))
        state[1][active[better]], state[0][active[better]] = least[better], number[better]
        return squares

    def _descend(self, node, queries, active, state) -> None:
        squares = self._offer(node.splits, queries, active, state)
        if node.children:
            nearest = squares.argmin(axis=1)
            for j, child in enumerate(node.children):
                own = active[nearest == j]
                if child is not None and len(own):
                    self._descend(child, queries, own, state)

    def _visit(self, node, queries, active, state) -> None:
        distance = _roots(self._offer(node.splits, queries, active, state))
        for j, child in enumerate(node.children):
            if child is None:
                continue
            radius = _roots(state[1][active])[:, None] * (1 + _SLACK)
            with np.errstate(invalid="ignore"):
                out = (distance * (1 - _SLACK) - node.high[:, j] > radius) | (node.low[:, j] - distance * (1 + _SLACK) > radius)
            left = active[~out.any(axis=1)]
            if len(left):
                self._visit(child, queries, left, state)


def _cuts(dim: int) -> list[int]:
    return [dim * p // PARTS for p in range(PARTS + 1)]


def _searches(books: list[np.ndarray]) -> list[Search]:
    return [Search(b) for b in books]


def encode(whole: np.ndarray, searches: list[Search]) -> tuple[np.ndarray, list[int]]:
    """(entry number per part, summed exact squared distances) of whole-number rows."""
    cuts = _cuts(whole.shape[1])
    codes, errors = np.empty((len(whole), PARTS), np.int64), [0] * len(whole)
    for p, search in enumerate(searches):
        codes[:, p], squares = search.nearest(whole[:, cuts[p]:cuts[p + 1]])
        errors = [e + int(s) for e, s in zip(errors, squares.tolist())]
    return codes, errors


def _step(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """One round: assign all parts, then move each used entry to its parts' floored mean.

    Tasks send a count and a sum per used entry; the driver gets the merged sums, at most
    PARTS * ENTRIES rows whatever the number of vectors.
    """
    cuts = _cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, sums = _searches(books), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = floors(matrix(batch.column("vector"), dim), FACTOR)
            for p, search in enumerate(searches):
                own = whole[:, cuts[p]:cuts[p + 1]]
                number, _ = search.nearest(own)
                order = np.argsort(number, kind="stable")
                used, first = np.unique(number[order], return_index=True)
                for e, part in zip(used.tolist(), np.split(own[order], first[1:])):
                    n, total = sums.get((p, e), (0, None))
                    new = column_sums(part)
                    sums[p, e] = (n + len(part), new if total is None else [a + b for a, b in zip(total, new)])
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([sums[k][0] for k in keys], pa.int64()),
             pa.array([[str(x) for x in sums[k][1]] for k in keys], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    partial = rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    out = [exact_ints(b) if b.dtype != object else b.copy() for b in books]
    for r in add_up(partial, ["part", "entry"]).collect():
        out[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
    return [_plain(b) for b in out]


def _plain(book: np.ndarray) -> np.ndarray:
    """Doubles where all entries are exact in them."""
    return book.astype(np.float64) if all(abs(x) < EXACT for x in book.ravel()) else book


def train_codebooks(rows: DataFrame, dim: int, id_col: str, vector_col: str) -> list[np.ndarray]:
    """The codebooks after ROUNDS rounds over all rows. They start as the ENTRIES smallest ids
    (nulls last, equal ids by vector); fewer rows give shorter codebooks."""
    named = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    first = named.orderBy(F.asc_nulls_last("id"), "vector").limit(ENTRIES).collect()
    whole = floors(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dim), FACTOR)
    cuts = _cuts(dim)
    books = [_plain(exact_ints(whole[:, cuts[p]:cuts[p + 1]])) for p in range(PARTS)]
    for _ in range(ROUNDS if len(first) else 0):
        books = _step(named, books, dim)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label") -> DataFrame:
    """One row per usable row: id, label, codes array<int>, error, label_error, codebooks_sha256.

    Vectors that are null, empty or hold a null or non-finite component are dropped, and so
    are those whose length is not the most frequent one. Components become floor(1024 x).
    Lengths that four does not divide are cut at floor(p * length / 4). error is the exact
    squared distance to the code, label_error its sum over rows of an equal label, nulls
    together; a sum beyond a long is null. Repeated rows count each.

    Each of the five passes reads the vectors where they lie; tasks know the codebooks (at
    most 1,024 entries) and search them through a GNAT per part. Errors of a label are
    combinable sums joined back; that join's hot labels can be split by adaptive execution.
    """
    good, dim = usable_rows(rows, vector_col)
    books = train_codebooks(good, dim, id_col, vector_col)
    narrow = good.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                         F.col(f"`{vector_col}`").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(books)
        for batch in batches:
            if batch.num_rows:
                codes, errors = encode(floors(matrix(batch.column("vector"), dim), FACTOR), searches)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array(codes.tolist(), pa.list_(pa.int32())),
                     pa.array([e if e < 2 ** 63 else None for e in errors], pa.int64())], ["id", "label", "codes", "error"])

    kinds = dict(narrow.dtypes)
    coded = stash(narrow.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.when(F.count("error") == F.count("*"), total).alias("total")).select(
        "of", F.expr("try_cast(total AS bigint)").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "id", "label", "codes", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def code_query(rows: DataFrame) -> DataFrame:
    out = compress_vectors(rows)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))))
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", "codebooks_sha256")
