"""Substring dedup by recompression: repeats of `width` words are removed where they come again.

Rounds of recompression rewrite the words of a document: first every run of one word gets a
name, then, round by round, every pair of neighbours whose left part falls in this round's
left half of all symbols and whose right part falls in the right half. A name is a 64-bit
fingerprint of what it names, so a round names equal parts alike in all documents without an
exchange. Whether two neighbours pair up depends on these two alone; so of a window of words
all but a symbol at each end per round is named the same wherever the window stands. The
symbol of the widest span in that core, at the highest level that has one, is the window's
anchor: equal windows have equal anchors.

Three passes over documents packed into slices, which are written once as a table bucketed by
slice; what comes back for a slice joins it without moving texts:

1. Anchors are counted in buckets of their fingerprint; anchors found once rule out all of
   their windows.
2. Windows at repeated anchors are verified: buckets of windows, dealt by the hash of all their
   words, find each window's first place. So the different windows around a phrase that very
   many documents hold are spread over all buckets, and a slice sends a window once, its first
   place there, so that a window which very many documents hold is sent once a slice.
3. Words covered by a window that is not the first of its kind are cut out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyweave.llm.common import mix, owners, slices, string_hash, word_lists
from tallyweave.session import ensure_checkpoint_dir

ROUNDS = 4
#: Bytes of text behind one bucket of anchors or windows; more text means more buckets.
BUCKET_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _level(level: int) -> np.uint64:
    return np.uint64(level * int(_ODD) & (1 << 64) - 1)


# ---- recompression of one slice ---------------------------------------------------------------

def _widest(sym: np.ndarray, span: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The symbol of the greatest span in each range [p, q), ties by fingerprint."""
    rank = np.minimum(span, 255).astype(np.uint64) << np.uint64(56) | mix(sym) >> np.uint64(8)
    best, top = p.copy(), rank[p]
    live = np.arange(len(p))
    for k in range(1, int((q - p).max(initial=0))):
        live = live[p[live] + k < q[live]]
        here = p[live] + k
        better = rank[here] > top[live]
        best[live[better]] = here[better]
        top[live[better]] = rank[here[better]]
    return best


def anchors(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the anchor of each (a number), and the fingerprints of anchors."""
    n = len(words)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(owner[:n - width + 1] == owner[width - 1:])
    which = np.empty(len(at), np.int64)
    keys: list[np.ndarray] = []
    used = 0

    def settle(rows: np.ndarray, names: np.ndarray, level: int) -> None:
        nonlocal used
        distinct, inverse = np.unique(names, return_inverse=True)
        which[rows] = used + inverse
        keys.append(mix(sym[distinct] + _level(level)))
        used += len(distinct)

    new = np.concatenate(([True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])))
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    span = np.diff(np.append(first, n))
    sym = np.where(span == 1, words[first], mix(words[first] * _ODD + span.astype(np.uint64)))
    own = owner[first]
    p, q = run[at] + 1, run[at + width - 1]
    rows = np.arange(len(at))
    bare = q <= p
    if bare.any():  # one or two runs fill the window: it is its own anchor
        whole = rows[bare]
        which[whole] = used + np.arange(len(whole))
        keys.append(window_fingerprints(words, at[whole], width) ^ _ODD)
        used += len(whole)
        rows, p, q = rows[~bare], p[~bare], q[~bare]
    for level in range(1, ROUNDS + 1):
        if not len(rows):
            break
        left = (mix(sym + _level(level)) & np.uint64(1)).astype(bool)
        joins = np.append(left[:-1] & ~left[1:] & (own[1:] == own[:-1]), False)
        kept = np.concatenate(([True], ~joins[:-1]))
        number = np.cumsum(kept) - 1
        inner_p, inner_q = p + ~left[p], q - left[q - 1]
        stops = inner_q <= inner_p
        if stops.any():
            settle(rows[stops], _widest(sym, span, p[stops], q[stops]), level)
            rows, inner_p, inner_q = rows[~stops], inner_p[~stops], inner_q[~stops]
        p, q = number[inner_p], number[inner_q - 1] + 1
        begin = np.flatnonzero(kept)
        pair = joins[begin]
        after = begin[pair] + 1
        sym2, span2 = sym[begin], span[begin]
        sym2[pair] = mix(mix(sym2[pair]) * _ODD + sym[after])
        span2[pair] += span[after]
        sym, span, own = sym2, span2, own[begin]
    if len(rows):
        settle(rows, _widest(sym, span, p, q), ROUNDS + 1)
    return at, which, np.concatenate(keys) if keys else np.empty(0, np.uint64)


def window_fingerprints(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the `width` words from each place in `at`, from one sum over all words."""
    base = np.uint64(0xD6E8FEB86659FD93)
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words), base))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + _ODD) * powers[:-1], dtype=np.uint64)))
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words), inverse))))
    return mix((sums[at + width] - sums[at]) * back[at])


class _Slice:
    """The documents of one slice, repeated rows once, with windows and anchors."""

    def __init__(self, rows: pa.StructArray, id_col: str, text_col: str, width: int):
        texts = rows.field(rows.type.get_field_index(text_col))
        ids = pc.fill_null(rows.field(rows.type.get_field_index(id_col)).cast(pa.int64()), _LAST)
        self.words, self.begins = word_lists(texts)
        coded = self.words.dictionary_encode()
        self.hashes = (string_hash(coded.dictionary)[np.asarray(coded.indices)]
                       if len(self.words) else np.empty(0, np.uint64))
        body = pc.fill_null(texts, "")
        self.ids = np.asarray(ids)
        self.marks = string_hash(body, 5).view(np.int64)
        order = np.lexsort((self.marks, self.ids))
        same = np.concatenate(([False], (self.ids[order][1:] == self.ids[order][:-1])
                               & (self.marks[order][1:] == self.marks[order][:-1])))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(~same) - 1
        self.copy_of = np.empty(len(order), np.int64)
        self.copy_of[order] = order[~same][np.cumsum(~same) - 1]
        self.rank = rank
        owner = owners(self.begins)
        at, which, self.keys = anchors(self.hashes, owner, width)
        once = self.copy_of[owner[at]] == owner[at] if len(at) else np.empty(0, bool)
        self.at, self.which = at[once], which[once]
        self.owner, self.width = owner, width
        self.distinct, self.anchor, self.uses = np.unique(self.keys, return_inverse=True, return_counts=True)

    def used_anchors(self) -> np.ndarray:
        return np.unique(self.anchor[self.which]) if len(self.which) else np.empty(0, np.int64)

    def candidates(self, buckets: int, found: bytes):
        """Windows at repeated anchors, in the order sent: (place, hash, bucket, send, first
        place here); `send` marks the first place in the slice of each hash."""
        used = self.used_anchors()
        order, _ = _by_bucket(_bucket(self.distinct[used], buckets), buckets)
        repeated = np.zeros(len(self.distinct), bool)
        if len(used):
            repeated[used[order]] = np.frombuffer(found, np.uint8) > 0
        live = repeated[self.anchor[self.which]] if len(self.which) else np.empty(0, bool)
        at = self.at[live]
        hashes = window_fingerprints(self.hashes, at, self.width) if len(at) else np.empty(0, np.uint64)
        owner = self.owner[at]
        place = self.rank[owner] << 32 | (at - self.begins[owner])
        by = np.lexsort((place, hashes))
        new = np.concatenate(([True], hashes[by][1:] != hashes[by][:-1])) if len(by) else np.empty(0, bool)
        send = np.zeros(len(at), bool)
        send[by[new]] = True
        return at, hashes, _bucket(hashes, buckets), send, owner


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


# ---- passes -----------------------------------------------------------------------------------

def _packed(docs: DataFrame, text_col: str, parts: int) -> DataFrame:
    """Rows of `docs` in slices: (slice, rows), bucketed by slice in the shared folder.

    Spark writes buckets to catalog tables only. The name goes once the table is read back;
    its files stay in the checkpoint folder like all other written tables.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"packed_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(slices(batches, text_col)):
            rows = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + k]),
                 pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["slice", "rows"])

    schema = StructType([StructField("slice", LongType()), StructField("rows", ArrayType(docs.schema))])
    docs.mapInArrow(run, schema).write.format("parquet").option("compression", "zstd").option(
        "path", f"{spark.sparkContext.getCheckpointDir()}/{name}").bucketBy(parts, "slice").saveAsTable(name)
    packed = spark.table(name)
    packed.schema  # resolves the files behind the name
    spark.sql(f"DROP TABLE {name}")
    return packed


def _each(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, width: int):
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            rows = row.column("rows").flatten()
            yield row, rows, _Slice(rows, id_col, text_col, width)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _replies(found: DataFrame, name: str) -> DataFrame:
    """Replies of all buckets to a slice, joined in the order of the buckets."""
    return found.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("all")).select(
        "slice", F.col("all.reply").alias(name))


def cut_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_words, n_removed and kept_text (replaced if there).

    A window is `width` consecutive words of one document. Every word is removed that is
    covered by a window whose word sequence also starts earlier: at a smaller id, or in the
    same document at an earlier place. Windows are judged on the texts given. kept_text holds
    the words left, joined by one blank. Null ids come last, and count as one id; documents
    of one id and different texts are ordered by a fingerprint of the text; rows that repeat
    (id, text) are one document and all get its result. Null texts have no words and an empty
    kept_text. Ids must be whole numbers. Words and windows are compared by 64-bit hashes.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept_columns])
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 << 20))
    packed = _packed(docs, text_col, parts)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, part in _each(batches, id_col, text_col, width):
            used = part.used_anchors()
            keys = part.distinct[used]
            often = np.bincount(part.anchor[np.unique(part.which)], minlength=len(part.distinct))[used] > 1 \
                if len(part.which) else np.empty(0, bool)
            order, edge = _by_bucket(_bucket(keys, buckets), buckets)
            short = (keys[order] >> np.uint64(32)).astype(np.uint32)
            often = often[order].astype(np.uint8)
            full = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full), pa.array(np.full(len(full), row.column("slice")[0].as_py())),
                 _binary([short[edge[b]:edge[b + 1]].tobytes() for b in full.tolist()]),
                 _binary([np.packbits(often[edge[b]:edge[b + 1]]).tobytes() for b in full.tolist()])],
                ["bucket", "slice", "tokens", "often"])

    def count_anchors(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(t, np.uint32) for t in table["tokens"].to_pylist()]
        often = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(t)) for o, t in
                                zip(table["often"].to_pylist(), tokens, strict=True)])
        _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        repeated = (np.bincount(inverse, 1 + often)[inverse] > 1).astype(np.uint8)
        edges = np.cumsum([0] + [len(t) for t in tokens]).tolist()
        return pa.table({"bucket": table["bucket"], "slice": table["slice"], "reply": _binary(
            [repeated[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)])})

    anchors_found = _replies(
        packed.mapInArrow(send_anchors, "bucket long, slice long, tokens binary, often binary").groupBy(
            "bucket").applyInArrow(count_anchors, "bucket long, slice long, reply binary"), "anchors_found")
    with_anchors = packed.join(anchors_found, "slice", "left")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, part in _each(batches, id_col, text_col, width):
            at, hashes, bucket, send, owner = part.candidates(buckets, b"".join(row.column("anchors_found")[0].as_py() or []))
            sent = np.flatnonzero(send)
            order, edge = _by_bucket(bucket[sent], buckets)
            sent = sent[order]
            full = np.flatnonzero(np.diff(edge)).tolist()
            cells: dict[str, list] = {"ids": [], "marks": [], "sizes": [], "starts": [], "hashes": []}
            for b in full:
                rows = sent[edge[b]:edge[b + 1]]
                docs_here, sizes = np.unique(owner[rows], return_counts=True)
                cells["ids"].append(part.ids[docs_here].tobytes())
                cells["marks"].append(part.marks[docs_here].tobytes())
                cells["sizes"].append(sizes.astype(np.uint32).tobytes())
                cells["starts"].append(np.diff((at[rows] - part.begins[owner[rows]]).astype(np.uint32), prepend=np.uint32(0)).tobytes())
                cells["hashes"].append(hashes[rows].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array(np.full(len(full), row.column("slice")[0].as_py())),
                 *(_binary(v) for v in cells.values())], ["bucket", "slice", *cells])

    def find_first(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> tuple[np.ndarray, list[int]]:
            found = [np.frombuffer(v, kind) for v in table[name].to_pylist()]
            return np.concatenate(found), [len(f) for f in found]

        ids, _ = joined("ids", np.int64)
        marks, _ = joined("marks", np.int64)
        sizes, _ = joined("sizes", np.uint32)
        hashes, counts = joined("hashes", np.uint64)
        starts = np.concatenate([np.cumsum(np.frombuffer(v, np.uint32), dtype=np.uint32)
                                 for v in table["starts"].to_pylist()]).astype(np.int64)
        order = np.lexsort((marks, ids))
        new = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        place = np.repeat(rank, sizes) << 32 | starts
        order = np.lexsort((place, hashes))
        new = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
        later = np.empty(len(order), bool)
        later[order] = place[order] > np.repeat(place[order][new], np.diff(np.append(new, len(order))))
        edges = np.cumsum([0] + counts).tolist()
        return pa.table({"bucket": table["bucket"], "slice": table["slice"], "reply": _binary(
            [np.packbits(later[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)])})

    windows_found = _replies(
        with_anchors.mapInArrow(send_windows, "bucket long, slice long, ids binary, marks binary, sizes binary, "
                                "starts binary, hashes binary").groupBy("bucket").applyInArrow(
            find_first, "bucket long, slice long, reply binary"), "windows_found")
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    schema = schema.add("kept_text", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows, part in _each(batches, id_col, text_col, width):
            at, hashes, bucket, send, owner = part.candidates(buckets, b"".join(row.column("anchors_found")[0].as_py() or []))
            sent = np.flatnonzero(send)
            order, edge = _by_bucket(bucket[sent], buckets)
            sent = sent[order]
            replies = row.column("windows_found")[0].as_py() or []
            sizes = np.diff(edge)
            bits = [np.unpackbits(np.frombuffer(r, np.uint8), count=int(c))
                    for r, c in zip(replies, sizes[sizes > 0], strict=True)]
            later = ~send
            later[sent] = np.concatenate(bits).astype(bool) if bits else False
            steps = np.zeros(len(part.words) + 1, np.int64)
            np.add.at(steps, at[later], 1)
            np.add.at(steps, at[later] + width, -1)
            covered = np.cumsum(steps[:-1]) > 0
            for copy in np.flatnonzero(part.copy_of != np.arange(len(part.copy_of))).tolist():
                own = part.copy_of[copy]
                covered[part.begins[copy]:part.begins[copy + 1]] = covered[part.begins[own]:part.begins[own + 1]]
            left = np.concatenate(([0], np.cumsum(~covered)))[part.begins]
            kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), part.words.filter(pa.array(~covered)))
            total = np.diff(part.begins)
            columns = [rows.field(k) for k in range(rows.type.num_fields)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(total), pa.array(total - np.diff(left)), pc.binary_join(kept, " ")],
                [*kept_columns, "n_words", "n_removed", "kept_text"])

    return with_anchors.join(windows_found, "slice", "left").mapInArrow(cut, schema)


def substring_query(docs: DataFrame) -> DataFrame:
    out = cut_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """`docs` with repeats cut out of the text; texts without a repeat stay as they are."""
    names = docs.columns
    out = cut_repeats(docs, width)
    return out.select(*[F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias(c)
                        if c == "text" else F.col(f"`{c}`") for c in names])
