"""N-gram Jaccard join: signature trees over word shingles, exact, one row per document.

Four steps, each exact, so that only sets that can link ever meet:

1. Filter. A set of n shingles that links must share all but u = n - ceil(t n) of them. So of
   its 2u + 1 least shingles u + 1 occur in another set, whose own least shingles they are
   among when that set sends enough of them. Shingles are counted in buckets of hash space;
   sets that fall short can link with nothing and go no further. Truncated hashes only let
   more sets through.
2. Candidates. Equal sets are one class. Classes left are counted again, their shingles are
   ordered from rare to frequent, and two classes that link share one of their u + 1 rarest.
   So what many documents share, a passage or a licence, is in nobody's prefix.
3. Trees. Connected candidates form a cluster. A cluster is dealt into tiles of bounded size;
   in each a signature tree (nodes with OR-combined bitmaps, size range and slack) is joined
   with itself by dual traversal. Pairs already connected are not compared.
4. What is left. Where a large cluster is not yet one component, the sets outside its
   largest component meet all others, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import SLICE_BYTES, mix, slices, stash, text_key, window_hashes, word_hashes
from tallyweave.llm.components import components

#: Shingle hashes that one bucket holds on average; more shingles mean more buckets.
BUCKET_TOKENS = 400_000
#: Sets in one tile, and branches of a tree node.
TILE, FANOUT = 512, 8
#: Tasks that share the rows of a large cluster when facts about it are joined.
SALTS = 64
#: Shingles in one tile on average, unless one set has more, and in all tiles of one bin.
TILE_TOKENS, BIN_TOKENS = 1_000_000, 2_000_000
BITS = 4096


def unshared(n, percent: int):
    """How many of n shingles a linked set can have for itself."""
    return n - (percent * n + 99) // 100


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lowered. A text of fewer words than
    `width` has one shingle, all its words; one without words has none."""
    words, begins = word_hashes(texts, lower=True)
    windows = window_hashes(words, width)
    out = []
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if end - start >= width:
            out.append(np.unique(windows[start:end - width + 1]))
        elif end > start:
            out.append(window_hashes(words[start:end], end - start, salt=1))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    both = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))) for s in sets]
    table = np.array(both, np.uint64).reshape(-1, 2).view(np.int64)
    return table[:, 0], table[:, 1]


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _repeated(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each token occurs, for every place."""
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    return counts[inverse], inverse


# ---- step 1: filter ---------------------------------------------------------------------------

_SENT = "bucket long, slice long, tokens binary, sizes binary, ids {id}, n binary, keys binary"


def _sent_tokens(docs: DataFrame, width: int, percent: int, buckets: int, id_type: str) -> DataFrame:
    """Per slice and bucket the least shingles of its documents, and per slice the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "slice", "tokens", "sizes", "ids", "n", "keys"]
        ids_type = None
        for k, part in enumerate(slices(batches, "text")):
            ids_type = ids_type or pa.list_(part.schema.field("id").type)
            sets = shingle_sets(part.column("text"), width)
            name = (TaskContext.get().partitionId() << 32) + k
            first, extra = [], []
            for s in sets:
                n = len(s)
                u = unshared(n, percent)
                judged = min(n, 2 * u + 1)
                widest = 100 * n // percent
                sent = min(n, 2 * unshared(widest, percent) + 1 + u)
                first.append(s[:judged])
                extra.append(s[judged:max(judged, sent)])
            runs = [x for pair in zip(first, extra, strict=True) for x in pair]
            tokens = np.concatenate(runs) if runs else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            place = _bucket(tokens, buckets) << 32 | (tokens >> np.uint64(32)).astype(np.int64)
            often = _repeated(place)[0] > 1 if len(place) else np.empty(0, bool)
            # What the slice itself repeats is counted here, and sent once for the others.
            own_hits = np.bincount(owner[often & (owner % 2 == 0)] // 2, minlength=len(sets))
            again = np.unique(place[often])
            place = np.concatenate((place[~often], again))
            owner = np.concatenate((owner[~often], np.full(len(again), len(runs))))
            order, edge = _by_bucket(place >> 32, buckets)
            short, owner = (place[order] & 0xFFFFFFFF).astype(np.uint32), owner[order]
            used = np.flatnonzero(np.diff(edge))
            cells = [(short[edge[b]:edge[b + 1]].tobytes(),
                      _size_cell(np.bincount(owner[edge[b]:edge[b + 1]], minlength=len(runs) + 1)))
                     for b in used.tolist()]
            none = pa.nulls(len(used), ids_type)
            blank = pa.nulls(len(used), pa.binary())
            yield _rows(names, used, np.full(len(used), name), pa.array([c[0] for c in cells], pa.binary()),
                        pa.array([c[1] for c in cells], pa.binary()), none, blank, blank)
            h1, h2 = _set_keys(sets)
            n = np.array([len(s) for s in sets], np.int64)
            yield _rows(names, [buckets + name % buckets], [name], pa.nulls(1, pa.binary()),
                        pa.array([own_hits.astype(np.uint32).tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), part.column("id")),
                        pa.array([n.tobytes()], pa.binary()), pa.array([np.stack((h1, h2, np.asarray(part.column("key")))).tobytes()], pa.binary()))

    return docs.mapInArrow(run, _SENT.format(id=f"array<{id_type}>"))


def _size_cell(sizes: np.ndarray) -> bytes:
    """Sizes in two bytes each, or in four with a mark in front where a giant text needs them."""
    if sizes.max(initial=0) > 65535:
        return b"L" + sizes.astype(np.uint32).tobytes()
    return sizes.astype(np.uint16).tobytes()


def _cell_sizes(raw: bytes) -> np.ndarray:
    wide = len(raw) % 2 == 1
    return np.frombuffer(raw, np.uint32, offset=1) if wide else np.frombuffer(raw, np.uint16)


def _answered(table: pa.Table) -> pa.Table:
    """Bucket rows become, per slice, how many of each document's judged shingles are repeated."""
    table = table.combine_chunks()
    names = table["tokens"].to_pylist()
    if names[0] is None:
        return table.select(["slice", "ids", "n", "keys"]).append_column("hits", table["sizes"])
    sizes = [_cell_sizes(raw).astype(np.int64) for raw in table["sizes"].to_pylist()]
    # The last size of a row counts shingles that its slice found more than once.
    weights = np.concatenate([np.repeat(np.arange(len(s)) == len(s) - 1, s) + 1 for s in sizes])
    _, inverse = np.unique(np.concatenate([np.frombuffer(t, np.uint32) for t in names]), return_inverse=True)
    repeated = np.bincount(inverse, weights)[inverse] > 1
    hits, at = [], 0
    for s in sizes:
        total = int(s.sum())
        run = np.repeat(np.arange(len(s)), s)
        judged = repeated[at:at + total] & (run % 2 == 0) & (run < len(s) - 1)
        hits.append(np.bincount(run[judged] // 2, minlength=len(s) // 2).astype(np.uint32).tobytes())
        at += total
    blank = pa.nulls(len(table), pa.binary())
    return pa.table({"slice": table["slice"], "ids": pa.nulls(len(table), table.schema.field("ids").type), "n": blank,
                     "keys": blank, "hits": pa.array(hits, pa.binary())})


def set_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, key, n, h1, h2, possible): the set of every row of docs (id, text, key), and whether step 1 leaves it."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size / 6 * min(1.0, 3.5 * (100 - percent) / 100)) // BUCKET_TOKENS)
    kind = dict(docs.dtypes)["id"]
    sent = _sent_tokens(docs, width, percent, buckets, kind)
    answers = sent.groupBy("bucket").applyInArrow(_answered, f"slice long, ids array<{kind}>, n binary, keys binary, hits binary")

    def gathered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hits = [np.frombuffer(h, np.uint32) for h in table["hits"].to_pylist() if h is not None]
        at = next(i for i, n in enumerate(table["n"].to_pylist()) if n is not None)
        n = np.frombuffer(table["n"][at].as_py(), np.int64)
        h1, h2, key = np.frombuffer(table["keys"][at].as_py(), np.int64).reshape(3, -1)
        u = unshared(n, percent)
        total = np.sum(hits, axis=0) if hits else np.zeros(len(n), np.int64)
        possible = (n > 0) & (total >= np.minimum(n, 2 * u + 1) - u)
        return pa.table({"id": table["ids"].chunk(0)[at].values, "key": key, "n": n, "h1": h1, "h2": h2, "possible": possible})

    return stash(answers.groupBy("slice").applyInArrow(
        gathered, f"id {kind}, key long, n long, h1 long, h2 long, possible boolean"))


# ---- step 2: candidates -----------------------------------------------------------------------

def _representatives(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, h1, h2, text): the rows of docs (id, text, key) that are a class's rep and
    rep_key, never more than docs has. Only repeated rows meet the same class again (of these
    a task keeps one)."""
    return docs.join(classes.select("rep", "rep_key", "class_id", "h1", "h2"),
                     F.col("id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("rep_key"))).select(
        "class_id", "h1", "h2", "text")


def _texts_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Texts of one document of each class, packed: (slice, classes, texts) of about 2 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for k, part in enumerate(slices(batches, "text")):
            ids = part.column("class_id").to_pylist()
            new = [i for i, c in enumerate(ids) if c not in seen and not seen.add(c)]
            if len(new) < len(ids):
                part = part.take(pa.array(new, pa.int64()))
            h1, h2 = _set_keys(shingle_sets(part.column("text"), width))
            right = (h1 == np.asarray(part.column("h1"))) & (h2 == np.asarray(part.column("h2")))
            kept = part.filter(pa.array(right))
            if len(kept):
                edges = pa.array([0, len(kept)], pa.int32())
                yield _rows(["slice", "classes", "texts"], [(TaskContext.get().partitionId() << 32) + k],
                            pa.ListArray.from_arrays(edges, kept.column("class_id")),
                            pa.ListArray.from_arrays(edges, kept.column("text")))

    return stash(_representatives(docs, classes).mapInArrow(run, "slice long, classes array<long>, texts array<string>"))


def _packs(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            yield row, np.asarray(row.column("classes").flatten()), shingle_sets(row.column("texts").flatten(), width)


def _frequency_class(counts: np.ndarray) -> np.ndarray:
    """Counts to 127 as they are, then by eighths of a doubling: one byte, in the counts' order."""
    return np.where(counts < 128, counts, np.minimum(255, 72 + 8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _stars(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its least ref, and the distinct pairs (ref, least ref of a shared key)."""
    order = np.lexsort((refs, keys))
    keys, refs = keys[order], refs[order]
    if not len(keys):
        return keys, refs, np.empty((2, 0), np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    least = np.repeat(refs[first], np.diff(np.concatenate((first, [len(keys)]))))
    pairs = np.unique(np.stack((refs, least))[:, refs != least], axis=1)
    return keys[first], refs[first], pairs


def candidate_edges(packs: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """(a, b): classes that share one of their u + 1 rarest shingles, as stars per shingle."""
    buckets = max(1, total // BUCKET_TOKENS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, sets in _packs(batches, width):
            tokens, often = np.unique(np.concatenate(sets), return_counts=True)
            order, edge = _by_bucket(_bucket(tokens, buckets), buckets)
            short = (tokens[order] >> np.uint64(32)).astype(np.uint32)
            often = np.minimum(often, 255).astype(np.uint8)[order]
            used = np.flatnonzero(np.diff(edge))
            yield _rows(["bucket", "slice", "tokens", "often"], used,
                        np.full(len(used), row.column("slice")[0].as_py()),
                        pa.array([short[edge[b]:edge[b + 1]].tobytes() for b in used.tolist()], pa.binary()),
                        pa.array([often[edge[b]:edge[b + 1]].tobytes() for b in used.tolist()], pa.binary()))

    def counted(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(t, np.uint32) for t in table["tokens"].to_pylist()]
        often = np.frombuffer(b"".join(table["often"].to_pylist()), np.uint8)
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        classes = _frequency_class(np.bincount(inverse, often)[inverse])
        edges = np.cumsum([0] + [len(p) for p in parts])
        return pa.table({"slice": table["slice"], "bucket": table["bucket"], "counts": pa.array(
            [classes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    counts = packs.mapInArrow(sent, "bucket long, slice long, tokens binary, often binary").groupBy("bucket").applyInArrow(
        counted, "slice long, bucket long, counts binary").groupBy("slice").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("found")).select(
        F.col("slice").alias("of"), F.col("found.counts").alias("counts"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, sets in _packs(batches, width):
            tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            order, _ = _by_bucket(_bucket(tokens, buckets), buckets)
            rank = np.empty(len(tokens), np.uint8)
            rank[order] = np.frombuffer(b"".join(row.column("counts")[0].as_py()), np.uint8)
            rank = rank[inverse]
            keys, refs, at = [], [], 0
            for number, s in zip(ids.tolist(), sets, strict=True):
                own = rank[at:at + len(s)]
                at += len(s)
                size = unshared(len(s), percent) + 1
                chosen = np.lexsort((s, own))[:size]
                chosen = chosen[own[chosen] > 1]
                keys.append(s[chosen])
                refs.append(np.full(len(chosen), number))
            # A slice sends a shingle once, for its least class; the others hang on that one.
            keys, refs, local = _stars(np.concatenate(keys), np.concatenate(refs))
            order, edge = _by_bucket(_bucket(keys, buckets), buckets)
            used = np.flatnonzero(np.diff(edge)).tolist()
            cells = [order[edge[b]:edge[b + 1]] for b in used]
            yield _rows(["bucket", "keys", "refs", "pairs"], pa.array([*used, buckets + int(ids[0]) % buckets], pa.int64()),
                        pa.array([*(keys[c].tobytes() for c in cells), b""], pa.binary()),
                        pa.array([*(refs[c].tobytes() for c in cells), b""], pa.binary()),
                        pa.array([*(b"" for _ in cells), local.tobytes()], pa.binary()))

    def stars(table: pa.Table) -> pa.Table:
        _, _, pairs = _stars(np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64),
                             np.frombuffer(b"".join(table["refs"].to_pylist()), np.int64))
        local = [np.frombuffer(p, np.int64).reshape(2, -1) for p in table["pairs"].to_pylist()]
        pairs = np.concatenate([pairs, *local], axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return packs.join(counts, F.col("slice") == F.col("of")).select("classes", "texts", "counts").mapInArrow(
        prefixes, "bucket long, keys binary, refs binary, pairs binary").groupBy("bucket").applyInArrow(stars, "a long, b long")


# ---- steps 3 and 4: signature trees -----------------------------------------------------------

class SignatureTree:
    """Levels of nodes over sets in a given order. A node holds the OR of its sets' bitmaps,
    their least and greatest size, and the most shingles that share bits within a set."""

    def __init__(self, sets: list[np.ndarray]):
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            spots = mix(s) & np.uint64(BITS - 1)
            np.bitwise_or.at(bits[i], (spots >> np.uint64(6)).astype(np.int64),
                             np.uint64(1) << (spots & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        slack = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, slack)]
        while len(bits) > 1:
            starts = np.arange(0, len(bits), FANOUT)
            bits = np.bitwise_or.reduceat(bits, starts, axis=0)
            low = np.minimum.reduceat(self.levels[-1][1], starts)
            high = np.maximum.reduceat(self.levels[-1][2], starts)
            slack = np.maximum.reduceat(slack, starts)
            self.levels.append((bits, low, high, slack))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal from the root: pairs of sets (a < b) that no bound excludes."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            bits, low, high, slack = self.levels[level]
            keep = []
            for k in range(0, len(a), 1 << 15):
                x, y = a[k:k + (1 << 15)], b[k:k + (1 << 15)]
                most = np.bitwise_count(bits[x] & bits[y]).sum(axis=1).astype(np.int64) + np.minimum(slack[x], slack[y])
                keep.append((100 * np.minimum(high[x], high[y]) >= percent * np.maximum(low[x], low[y]))
                            & ((100 + percent) * most >= percent * (low[x] + low[y])))
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
            if level:
                below = len(self.levels[level - 1][1])
                spread = np.arange(FANOUT)
                a = (a[:, None, None] * FANOUT + spread[None, :, None]).repeat(FANOUT, axis=2).ravel()
                b = (b[:, None, None] * FANOUT + spread[None, None, :]).repeat(FANOUT, axis=1).ravel()
                inside = (a < below) & (b < below) & (a <= b)
                a, b = a[inside], b[inside]
        return a[a < b], b[a < b]


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def tile_edges(sets: list[np.ndarray], groups: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of which those of one group are connected."""
    order = sorted(range(len(sets)), key=lambda i: (sets[i][:1].tolist(), len(sets[i])))
    found: list[tuple[int, int]] = []
    names = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    node = [names[g] for g in groups]
    parent = list(range(len(names)))
    for x, y in zip(*(v.tolist() for v in SignatureTree([sets[i] for i in order]).pairs(percent)), strict=True):
        x, y = order[x], order[y]
        rx, ry = _root(parent, node[x]), _root(parent, node[y])
        if rx == ry:
            continue
        a, b = sets[x], sets[y]
        shared = len(a) + len(b) - len(np.union1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            parent[rx] = ry
            found.append((x, y))
    return found


def _joined_tiles(tiles: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links found in `tiles` (bin, cluster, tile, class_id, component, text)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, tile = np.asarray(table["cluster"]), np.asarray(table["tile"])
        order = np.lexsort((np.asarray(table["class_id"]), tile, cluster))
        cluster, tile = cluster[order], tile[order]
        new = np.concatenate(([True], (cluster[1:] != cluster[:-1]) | (tile[1:] != tile[:-1])))
        edges = np.append(np.flatnonzero(new), len(order))
        ids, groups = np.asarray(table["class_id"]), np.asarray(table["component"])
        texts = table["text"].combine_chunks()
        links: list[tuple[int, int]] = []
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[start:end]
            rows = rows[np.concatenate(([True], ids[rows[1:]] != ids[rows[:-1]]))]
            sets = []
            for piece in slices([pa.RecordBatch.from_arrays([texts.take(pa.array(rows))], ["text"])], "text"):
                sets += shingle_sets(piece.column("text"), width)
            links += [(int(ids[rows[x]]), int(ids[rows[y]])) for x, y in tile_edges(sets, groups[rows].tolist(), percent)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return tiles.groupBy("bin").applyInArrow(run, "a long, b long")


def _blocks(sets, tokens):
    """Blocks for so many sets with so many shingles: no more than TILE sets or TILE_TOKENS
    shingles each on average, and no more blocks than sets."""
    return F.least(sets, F.greatest(F.ceil(sets / TILE), F.ceil(tokens / TILE_TOKENS))).cast("int")


def _binned(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Tiles with their texts, dealt to bins by the shingles that all tiles together hold."""
    bins = max(1, -(-int(tiles.agg(F.sum("n")).first()[0] or 0) // BIN_TOKENS))
    return tiles.join(texts, "class_id").select(
        F.pmod(F.xxhash64("cluster", "tile"), F.lit(bins)).alias("bin"), "cluster", "tile", "class_id", "component", "text")


def _with_cluster(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """`rows` (class_id, cluster, ...) with the columns of `facts`, which has a row per large
    cluster; null for others. Rows of a cluster are dealt over SALTS tasks, its facts to all."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["cluster", "salt"], "left").drop("salt")


def _verified(packs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect exactly what the join's links connect, within clusters
    (class_id, n, cluster)."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"),
                                            F.min("class_id").alias("pivot"))
    # Clusters of one block, which is nearly all, need no facts about themselves.
    tall = sizes.select("cluster", "pivot", _blocks(F.col("size"), F.col("tokens")).alias("blocks")).where("blocks > 1")
    known = _with_cluster(clusters, tall).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    # The first set of a cluster sits in every tile, so that tiles which reach it are connected.
    dealt = known.withColumn("tile", F.explode(F.when(
        F.coalesce(F.col("class_id") == F.col("pivot"), F.lit(False)), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    texts = packs.select(F.explode(F.arrays_zip("classes", "texts")).alias("d")).select(
        F.col("d.classes").alias("class_id"), F.col("d.texts").alias("text"))
    first = stash(_joined_tiles(_binned(dealt.withColumn("component", F.col("class_id")), texts), width, percent))
    large = known.where("blocks > 1")
    if large.limit(1).count() == 0:
        return first
    parts = large.join(components(first).withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "cluster", "class_id", "n", F.coalesce("component", "class_id").alias("component"))
    main = parts.groupBy("cluster", "component").agg(F.count("*").alias("size")).groupBy("cluster").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"))
    parts = _with_cluster(parts, main).withColumn("open", F.col("component") != F.col("main"))
    share = lambda side, value: F.coalesce(F.sum(F.when(side, value)), F.lit(0)) * 2
    blocks = parts.groupBy("cluster").agg(*[
        _blocks(share(side, F.lit(1)), share(side, F.col("n"))).alias(name)
        for side, name in ((F.col("open"), "open_blocks"), (~F.col("open"), "rest_blocks"))]).where("open_blocks > 0")
    met = _with_cluster(parts, blocks).where("open_blocks is not null")
    number = F.pmod(F.xxhash64("class_id", F.lit(7)), F.when(F.col("open"), F.col("open_blocks")).otherwise(F.col("rest_blocks")))
    met = met.withColumn("own", number.cast("long"))
    # A tile joins two open blocks, or an open block and one of the rest: i * (open + rest) + j.
    width_all = F.col("open_blocks") + F.col("rest_blocks")
    everywhere = F.sequence(F.lit(0), width_all - 1)
    opened = F.transform(everywhere, lambda j: F.when(
        j < F.col("open_blocks"), F.least(F.col("own"), j.cast("long")) * width_all + F.greatest(F.col("own"), j.cast("long"))
    ).otherwise(F.col("own") * width_all + j))
    rest = F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1),
                       lambda i: i * width_all + F.col("open_blocks") + F.col("own"))
    tiles = met.withColumn("tile", F.explode(F.when(F.col("open"), opened).otherwise(rest)))
    second = _joined_tiles(_binned(tiles, texts), width, percent)
    return first.unionByName(stash(second))


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The set table of `docs`, and (n, h1, h2, component, least) of its sets."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_key(text).alias("key"))
    table = set_table(narrow, width, percent)
    classes = stash(table.where("n > 0").groupBy("n", "h1", "h2").agg(
        F.min("id").alias("rep"), F.coalesce(F.min_by("key", "id"), F.min("key")).alias("rep_key"),
        F.max("possible").alias("possible")).withColumn(
        "class_id", F.monotonically_increasing_id()))
    live = classes.where("possible")
    total = live.agg(F.sum("n")).first()[0] or 0
    packs = _texts_of(narrow, live, width)
    clusters = stash(components(candidate_edges(packs, width, percent, total)).select(
        F.col("node").alias("class_id"), F.col("component").alias("cluster")).join(live.select("class_id", "n"), "class_id"))
    linked = components(_verified(packs, clusters, width, percent)).withColumnRenamed("node", "class_id")
    named = classes.join(linked, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    return table, named.join(least, "component").select("n", "h1", "h2", "component", "least")


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id.

    Two rows link when 100 * shared >= percent * all shingles (1 <= percent <= 100), a shingle
    being `width` words in A-Z lower case. component_id is the least id reachable by links.
    Null texts and texts without words have no shingle and link with nothing (their own id).
    Shorter texts have one shingle. Equal sets always link, repeated rows too; a null id is
    never the least. Shingles are compared by 64-bit hashes, whole texts are read, and no
    bucket, cluster or list of partners is cut short.

    `docs` is read twice and its tasks may run again when an executor is lost, so it should be
    a table, or anything else whose partitions come out alike each time.
    """
    table, named = _grouped(docs, width, percent, id_col, text_col)
    return table.join(named, ["n", "h1", "h2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def jaccard_query(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs, width=3, percent=90).withColumnRenamed("id", "doc_id")


def keep_first_of_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents: that of the least doc_id, null ids last,
    then of the least text fingerprint. Rows that repeat this (doc_id, text) are one document,
    of which the row that comes first as JSON stays. Rows without words link with nothing, so
    all of them stay."""
    table, named = _grouped(docs, width, percent, "doc_id", "text")
    rows = table.where("n > 0").groupBy("id", "key", "n", "h1", "h2").agg(F.count("*").alias("copies")).join(
        named.drop("least"), ["n", "h1", "h2"])
    place = F.struct(F.col("id").isNull().alias("late"), "id", "key")
    first = rows.groupBy("component").agg(F.min(place).alias("first"))
    # Only documents that lose, or that are there more than once, are looked up again.
    judged = stash(rows.join(first, "component").select("id", "key", (place == F.col("first")).alias("wins"), "copies").where(
        "not wins or copies > 1").select("id", "key", "wins"))
    this = F.col("d.doc_id").eqNullSafe(F.col("g.id")) & (text_key(F.col("d.text").cast("string")) == F.col("g.key"))
    kept = docs.alias("d").join(judged.alias("g"), this, "left_anti")
    repeated = judged.where("wins")
    if repeated.limit(1).count() == 0:
        return kept
    whole = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns])
    once = docs.alias("d").join(repeated.alias("g"), this).groupBy("g.id", "g.key").agg(
        F.min_by(whole, F.to_json(whole)).alias("row"))
    return kept.unionByName(once.select("row.*"))
