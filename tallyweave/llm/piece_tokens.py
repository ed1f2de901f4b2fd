"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The vocabulary merges by score. A row of pieces is the encoding of its text exactly if each
piece encodes to itself and each two neighbours, encoded together, give these two again. So
the encoding is the one path of weight 0 in a lattice whose nodes are (place, last piece)
and whose edges weigh 0 where neighbours agree and minus infinity elsewhere, and the max-plus
products of transfer matrices over chunks give it for a text cut anywhere.

A state at a chunk's edge is (piece, overhang): the piece that starts before the edge and
ends `overhang` characters behind it. A chunk's matrix has the exit states that each entry
state reaches; since one path at most joins two states, the matrix is a set of pairs. Chunks
are scanned apart, their matrices combined in order, and with entry and exit state known each
chunk traces its pieces back by itself. Where a blank follows another character every piece
ends, so there the only state is the start.

Documents up to CHUNK characters are one chunk, and their words run through the same lattice
side by side, each distinct word once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.llm.common import flat_array, mix, ranges, slices, stash

CHUNK = 65_536
#: Longer words leave the side-by-side lattice for the scan by chunks of this many characters.
LONG_WORD = 64
#: Bytes of text worked on at once; the lattice takes some hundred bytes for each.
SLICE = 1 << 20
BLANK = "▁"
_MEMO_BITS = 20
_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
State = tuple[int, int] | None
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary file: pieces, ranks, and which neighbours agree."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(k) for k in every]
        plain = [k for k in every if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.ids = {self.text[k]: k for k in plain}
        self.rank = {k: -model.get_score(k) for k in plain}
        self.byte_id = {int(self.text[k][3:5], 16): k for k in every if model.is_byte(k)}
        self.unknown = len(self.text)  # stands for one character without a piece
        self.raw = [self.text[k].replace(BLANK, " ").encode() for k in every]
        for byte, k in self.byte_id.items():
            self.raw[k] = bytes([byte])
        for k in every:
            if model.is_control(k):
                self.raw[k] = b""
        self.longest = max(map(len, self.ids))
        if any(BLANK in t.lstrip(BLANK) for t in self.ids):
            raise ValueError("a piece holds a blank behind another character: words cannot be told apart")
        self.splits: dict[int, tuple[int, int] | None | bool] = {}
        self.spines: dict[tuple[int, bool], tuple[list[int], list[float]]] = {}
        self.agreed: dict[tuple[int, int], bool] = {}
        self.known_use = np.full(self.unknown + 1, -1, np.int8)
        self.known_use[self.unknown] = 1
        self._hash_pieces()

    # -- which neighbours agree --

    def split(self, piece: int):
        """The two parts that a piece's last merge joins; None for one character, False for a
        piece that no merges make."""
        if piece not in self.splits:
            parts = [self.ids.get(c) for c in self.text[piece]]
            found: tuple[int, int] | None | bool = None if len(parts) == 1 else False
            while len(parts) > 1 and None not in parts:
                joined = [self.ids.get(self.text[a] + self.text[b]) for a, b in zip(parts[:-1], parts[1:], strict=True)]
                best = min((self.rank[j], k) for k, j in enumerate(joined) if j is not None)[1] \
                    if any(j is not None for j in joined) else -1
                if best < 0:
                    break
                if len(parts) == 2:
                    found = (parts[0], parts[1])
                parts[best:best + 2] = [joined[best]]
            self.splits[piece] = found
        return self.splits[piece]

    def spine(self, piece: int, right: bool) -> tuple[list[int], list[float]]:
        """The piece's outermost parts on one side, from one character up to the whole, and
        the rank at which each grows into the next."""
        if (piece, right) not in self.spines:
            parts = [piece]
            while self.split(parts[-1]):
                parts.append(self.split(parts[-1])[1 if right else 0])
            parts.reverse()
            self.spines[piece, right] = parts, [self.rank[p] for p in parts[1:]] + [float("inf")]
        return self.spines[piece, right]

    def agree(self, a: int, b: int) -> bool:
        """True if `a` followed by `b` encodes to these two: while both grow from characters,
        the parts that meet never merge first. Of equal ranks the leftmost merge comes first."""
        if a == self.unknown or b == self.unknown:
            return True
        key = a, b
        if key not in self.agreed:
            if len(self.agreed) > 1 << 19:
                self.agreed.clear()
            (left, left_at), (right, right_at) = self.spine(a, True), self.spine(b, False)
            i = j = 0
            while True:
                across = self.ids.get(self.text[left[i]] + self.text[right[j]])
                when = self.rank[across] if across is not None else float("inf")
                if when < left_at[i] and when <= right_at[j]:
                    self.agreed[key] = False
                    break
                if left_at[i] == right_at[j] == float("inf"):
                    self.agreed[key] = True
                    break
                if left_at[i] <= right_at[j]:
                    i += 1
                else:
                    j += 1
        return self.agreed[key]

    def usable(self, piece: int) -> bool:
        return self.split(piece) is not False

    def usable_all(self, pieces: np.ndarray) -> np.ndarray:
        for piece in np.unique(pieces[self.known_use[pieces] < 0]).tolist():
            self.known_use[piece] = self.usable(piece)
        return self.known_use[pieces] == 1

    # -- pieces by hash, for many words at once --

    def _hash_pieces(self) -> None:
        names = [t for t in self.ids if len(t) > 1]
        hashes = np.array([self._fold(t) for t in names], np.uint64)
        ids = np.array([self.ids[t] for t in names], np.int64)
        order = np.argsort(hashes)
        self.piece_hash, self.piece_id = hashes[order], ids[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.table = np.full(1 << 20, -1, np.int64)
        self.table[(self.piece_hash >> np.uint64(44)).astype(np.int64)] = np.arange(len(order))
        single = [t for t in self.ids if len(t) == 1]
        self.char_point = np.array(sorted(map(ord, single)), np.uint32)
        self.char_id = np.array([self.ids[chr(p)] for p in self.char_point], np.int64)
        self.memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.memo_value = np.zeros(1 << _MEMO_BITS, bool)

    @staticmethod
    def _fold(text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = mix(h + np.uint64(ord(c) + 1))
        return int(h[0])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        spot = self.table[(hashes >> np.uint64(44)).astype(np.int64)]
        found = np.where(self.piece_hash[spot] == hashes, self.piece_id[spot], -1)
        odd = np.flatnonzero((spot >= 0) & (found < 0))
        if len(odd):
            at = np.minimum(np.searchsorted(self.piece_hash, hashes[odd]), len(self.piece_hash) - 1)
            found[odd] = np.where(self.piece_hash[at] == hashes[odd], self.piece_id[at], -1)
        found[spot < 0] = -1
        return found

    def agree_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * (self.unknown + 1) + b
        slot = (mix(keys.view(np.uint64)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        known = self.memo_key[slot] == keys
        if not known.all():
            new = np.unique(keys[~known])
            values = self.usable_all(new % (self.unknown + 1))
            values &= np.fromiter((self.agree(*divmod(k, self.unknown + 1)) for k in new.tolist()), bool, len(new))
            out = self.memo_value[slot]
            out[~known] = values[np.searchsorted(new, keys[~known])]
            at = (mix(new.view(np.uint64)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
            self.memo_key[at], self.memo_value[at] = new, values
            return out
        return self.memo_value[slot]

    # -- the lattice over many short words --

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(sizes > LONG_WORD)
        scanned = {int(k): self.scan_word(words[k]) for k in long}
        if scanned:
            words = ["" if k in scanned else w for k, w in enumerate(words)]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n, top = len(points), int(sizes.max(initial=0))
        room = np.repeat(base + sizes, sizes) - np.arange(n)  # characters to the end of the word
        at = np.minimum(np.searchsorted(self.char_point, points), len(self.char_point) - 1)
        pieces = [np.where(self.char_point[at] == points, self.char_id[at], self.unknown).astype(np.int32)]
        hashes = mix(points.astype(np.uint64) + np.uint64(1))
        for size in range(2, min(self.longest, top) + 1):
            fits = np.flatnonzero(room >= size)
            hashes[fits] = mix(hashes[fits] + points[fits + size - 1].astype(np.uint64) + np.uint64(1))
            found = np.full(n, -1, np.int32)
            found[fits] = self.lookup(hashes[fits])
            pieces.append(found)
        last = np.full(n + 1, -1, np.int32)  # last piece of the path to behind each character
        live = np.arange(len(words))
        for end in range(1, top + 1):
            live = live[sizes[live] >= end]
            tail = base[live] + end - 1
            for size in range(1, min(end, self.longest) + 1):
                piece = pieces[size - 1][tail - size + 1]
                open_ = np.flatnonzero((piece >= 0) & (last[tail] < 0))
                if size < end:
                    open_ = open_[last[tail[open_] - size] >= 0]
                    good = self.agree_all(last[tail[open_] - size], piece[open_])
                else:
                    good = self.usable_all(piece[open_])
                chosen = open_[good]
                last[tail[chosen]] = piece[chosen]
        length = np.array([len(t) for t in self.text] + [1], np.int64)
        rows, steps = np.arange(len(words)), []
        place = base + sizes - 1
        left = sizes.copy()
        while True:
            rows = rows[left[rows] > 0]
            if not len(rows):
                break
            piece = last[place[rows]]
            steps.append((rows, piece, place[rows]))
            place[rows] -= length[piece]
            left[rows] -= length[piece]
        if not steps:
            ids, counts = np.empty(0, np.int64), np.zeros(len(words), np.int64)
        else:
            owner, ids, where = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
            order = np.argsort(where, kind="stable")
            owner, ids, where = owner[order], ids[order], where[order]
            ids, owner = self._with_bytes(ids, owner, points[where])
            counts = np.bincount(owner, minlength=len(words))
        if not scanned:
            return ids, counts
        parts, begin = [], np.cumsum(counts) - counts
        for k in range(len(words)):
            parts.append(np.array(scanned[k], np.int64) if k in scanned else ids[begin[k]:begin[k] + counts[k]])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _with_bytes(self, ids: np.ndarray, owner: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero(ids == self.unknown)
        if not len(odd):
            return ids, owner
        spelled = [self.spell(chr(int(p))) for p in points[odd]]
        counts = np.ones(len(ids), np.int64)
        counts[odd] = [len(s) for s in spelled]
        out = np.repeat(ids, counts)
        begin = np.cumsum(counts) - counts
        out[ranges(begin[odd], counts[odd])] = [b for s in spelled for b in s]
        return out, np.repeat(owner, counts)

    def spell(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()]

    # -- chunks of one text --

    def pieces_at(self, text: str, start: int):
        """(piece, end) of every piece that begins at `start`."""
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            piece = self.ids.get(text[start:end])
            if piece is None and end == start + 1:
                piece = self.unknown
            if piece is not None and (piece == self.unknown or self.usable(piece)):
                yield piece, end

    def entry_states(self, text: str, edge: int) -> list[State]:
        """All states at `edge` that the text around it allows."""
        return [(piece, end - edge) for start in range(max(0, edge - self.longest), edge)
                for piece, end in self.pieces_at(text, start) if end >= edge]

    def reach(self, text: str, start: int, end: int, entry: State) -> tuple[dict[State, int], dict[int, int]]:
        """Follow the lattice from `entry` at `start`: the exit states at `end`, each with the
        place where its piece begins, and the last piece of the path to each place before."""
        piece, over = entry or (-1, 0)
        last = {start + over: piece}
        if start + over >= end and entry:
            return {(piece, start + over - end): start - 1}, last
        exits: dict[State, int] = {}
        for place in range(start + over, end):
            if place not in last:
                continue
            for found, stop in self.pieces_at(text, place):
                if last[place] < 0 or self.agree(last[place], found):
                    if stop < end:
                        last[stop] = found
                    else:
                        exits[found, stop - end] = place
        return exits, last

    def trace(self, text: str, start: int, end: int, entry: State, goal: State) -> list[int]:
        """Ids of the pieces that begin in [start, end) on the path from `entry` to `goal`."""
        exits, last = self.reach(text, start, end, entry)
        place, found = exits[goal], []
        if place < start:
            return []
        found.append((goal[0], place))
        begin = start + (entry[1] if entry else 0)
        while place > begin:
            piece = last[place]
            place -= 1 if piece == self.unknown else len(self.text[piece])
            found.append((piece, place))
        ids: list[int] = []
        for piece, place in reversed(found):
            ids += self.spell(text[place]) if piece == self.unknown else [piece]
        return ids

    def scan_word(self, word: str, size: int = LONG_WORD) -> list[int]:
        """Ids of one word by chunks: transfer matrices, their product, and traces."""
        edges = [*range(0, len(word), size), len(word)]
        matrices = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            entries = [None] if a == 0 else self.entry_states(word, a)
            matrices.append({e: set(self.reach(word, a, b, e)[0]) for e in entries})
        states = chosen_states(matrices)
        return [k for (a, b), x, y in zip(zip(edges[:-1], edges[1:], strict=True), states[:-1], states[1:], strict=True)
                for k in self.trace(word, a, b, x, y)]


def chosen_states(matrices: list[dict[State, set[State]]]) -> list[State]:
    """The states at all edges of the path from the start to a piece that ends the text."""
    reached: list[set[State]] = [{None}]
    for matrix in matrices:
        reached.append({y for x in reached[-1] for y in matrix.get(x, ())})
    state = next(s for s in reached[-1] if s is None or s[1] == 0)
    states = [state]
    for matrix, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        state = next(x for x in before if state in matrix.get(x, ()))
        states.append(state)
    return states[::-1]


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_texts(pieces: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each begins (n + 1)."""
    texts = pc.fill_null(flat_array(texts), "")
    odd = np.asarray(pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, f"  |^ | $|{BLANK}")))
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    opens = np.cumsum(counts) - counts
    coded = lists.flatten().dictionary_encode()
    words = [BLANK + w for w in coded.dictionary.to_pylist()]
    numbers = {w: k for k, w in enumerate(words)}
    special = {}
    for k in np.flatnonzero(odd).tolist():
        text = texts[k].as_py()
        units = _UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []
        special[k] = np.array([numbers.setdefault(u, len(numbers)) for u in units], np.int64)
    ids, sizes = pieces.encode_words(list(numbers))
    total = counts.copy()
    for k, units in special.items():
        total[k] = len(units)
    begin = np.cumsum(total) - total
    codes = np.empty(int(total.sum()), np.int64)
    plain = np.flatnonzero(~odd)
    codes[ranges(begin[plain], counts[plain])] = np.asarray(coded.indices).astype(np.int64)[ranges(opens[plain], counts[plain])]
    for k, units in special.items():
        codes[begin[k]:begin[k] + len(units)] = units
    at = np.cumsum(sizes) - sizes
    out = ids[ranges(at[codes], sizes[codes])]
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))
    return out, ends[np.concatenate((begin, [len(codes)]))]


def decode_ids(pieces: Pieces, ids) -> str:
    """The text of a list of ids: bytes joined, the blank before the first word taken off,
    what is no UTF-8 replaced. Ids outside the vocabulary raise an IndexError."""
    raw = b"".join([pieces.raw[k] for k in ids])
    return raw.decode("utf-8", "replace").removeprefix(" ")


# ---- Spark ------------------------------------------------------------------------------------

def id_lists(pieces: Pieces, texts: pa.Array, ids: np.ndarray, begins: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))]


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, text_col: str = "text", finish=id_lists,
           made: str = "ids array<int>") -> DataFrame:
    """`docs` with a column ids (array<int>, replaced if there), or what `finish` makes.

    `finish` gets the vocabulary, texts, ids and where each text's begin, and returns arrays
    for the columns of the schema `made`, so that digests need not carry the ids along.

    The ids are those of the vocabulary file's own library for the whole text; a null or empty
    text has none. Documents over `chunk` characters are cut into chunks that are rows of
    their own: dealt over the cluster, scanned, combined per document from their small
    matrices, and traced apart. Rows that repeat are encoded each.
    """
    new = _parse_schema(made)
    kept = [c for c in docs.columns if c not in new.names]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    size = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0))
    schema = StructType([*plain.schema.fields, *new.fields])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for part in slices(batches, text_col, SLICE):
            ids, begins = encode_texts(pieces, part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *finish(pieces, part.column(text_col), ids, begins)], [*kept, *new.names])

    small = plain.where(size <= chunk).mapInArrow(short, schema)
    giant = stash(plain.where(size > chunk).select(
        F.monotonically_increasing_id().alias("row_no"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")))
    texts = giant.select("row_no", F.col("doc").getField(text_col).alias("text"))
    ids = encode_chunks(texts, model, chunk)
    whole = giant.join(ids, "row_no").select("doc", "ids")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            columns = dict(zip(kept, batch.column("doc").flatten(), strict=True))
            lists = batch.column("ids")
            begins = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), *finish(pieces, columns[text_col], np.asarray(lists.flatten()), begins)],
                [*kept, *new.names])

    return small.unionByName(whole.mapInArrow(end, schema))


def _parse_schema(made: str) -> StructType:
    return StructType.fromDDL(made)


def encode_chunks(texts: DataFrame, model: str, chunk: int) -> DataFrame:
    """(row_no, ids) of (row_no, text), chunk by chunk."""
    halo = load(model).longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row_no").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = BLANK + text.replace(" ", BLANK)
                for number, start in enumerate(range(0, len(text), chunk)):
                    end = min(len(text), start + chunk)
                    low, high = max(0, start - halo), min(len(text), end + halo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([number]), pa.array([text[low:high]]),
                         pa.array([start - low]), pa.array([end - low]), pa.array([end == len(text)])],
                        ["row_no", "number", "part", "start", "stop", "final"])

    chunks = stash(texts.mapInArrow(cut, "row_no long, number long, part string, start long, stop long, final boolean")
                   .repartition(F.col("row_no"), F.col("number")))
    state = "struct<piece:int,over:int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for row in batch.to_pylist():
                rows = _chunk_matrix(pieces, row)
                yield pa.RecordBatch.from_pylist(
                    [{"row_no": row["row_no"], "number": row["number"], "pairs": [
                        {"x": _packed(x), "y": _packed(y)} for x, ys in rows.items() for y in ys]}], scan_schema)

    scan_schema = pa.schema([("row_no", pa.int64()), ("number", pa.int64()), ("pairs", pa.list_(pa.struct(
        [(n, pa.struct([("piece", pa.int32()), ("over", pa.int32())])) for n in ("x", "y")])))])

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        matrices: list[dict[State, set[State]]] = []
        for row in rows:
            matrix: dict[State, set[State]] = {}
            for pair in row["pairs"]:
                matrix.setdefault(_state(pair["x"]), set()).add(_state(pair["y"]))
            matrices.append(matrix)
        states = chosen_states(matrices)
        return pa.Table.from_pylist(
            [{"row_no": r["row_no"], "number": r["number"], "entry": _packed(x), "goal": _packed(y)}
             for r, x, y in zip(rows, states[:-1], states[1:], strict=True)],
            pa.schema([("row_no", pa.int64()), ("number", pa.int64()),
                       *((n, pa.struct([("piece", pa.int32()), ("over", pa.int32())])) for n in ("entry", "goal"))]))

    chosen = chunks.mapInArrow(
        scan, f"row_no long, number long, pairs array<struct<x:{state},y:{state}>>").groupBy("row_no").applyInArrow(
        combine, f"row_no long, number long, entry {state}, goal {state}")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _chunk_ids(pieces, row, _state(row["entry"]), _state(row["goal"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["row_no"]]), pa.array([row["number"]]), pa.array([ids], pa.list_(pa.int32()))],
                    ["row_no", "number", "ids"])

    traced = chunks.join(chosen, ["row_no", "number"]).mapInArrow(back, "row_no long, number long, ids array<int>")
    return traced.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("all")).select(
        "row_no", F.flatten(F.col("all.ids")).alias("ids"))


def _packed(state: State) -> dict:
    return {"piece": -1, "over": 0} if state is None else {"piece": state[0], "over": state[1]}


def _state(packed: dict) -> State:
    return None if packed["piece"] < 0 else (packed["piece"], packed["over"])


def _breaks(row: dict) -> list[int]:
    """Places in the chunk where a word begins: a blank behind another character."""
    text = row["part"]
    return [k for k in range(max(row["start"], 1), row["stop"]) if text[k] == BLANK and text[k - 1] != BLANK]


def _chunk_matrix(pieces: Pieces, row: dict) -> dict[State, set[State]]:
    text, start, stop = row["part"], row["start"], row["stop"]
    breaks = _breaks(row)
    entries = [None] if row["number"] == 0 else pieces.entry_states(text, start)
    if row["final"]:
        text = text[:stop]
    if not breaks:
        return {e: set(pieces.reach(text, start, stop, e)[0]) for e in entries}
    exits = set(pieces.reach(text, breaks[-1], stop, None)[0])
    if breaks[0] == start:
        heads = [e for e in entries if e is None or e[1] == 0]
    else:
        heads = [e for e in entries if any(x[1] == 0 for x in pieces.reach(text, start, breaks[0], e)[0])]
    return {e: exits for e in heads}


def _chunk_ids(pieces: Pieces, row: dict, entry: State, goal: State) -> list[int]:
    text, start, stop = row["part"], row["start"], row["stop"]
    breaks = _breaks(row)
    if row["final"]:
        text = text[:stop]
    if not breaks:
        return pieces.trace(text, start, stop, entry, goal)
    ids: list[int] = []
    if breaks[0] > start:
        ends = [x for x in pieces.reach(text, start, breaks[0], entry)[0] if x[1] == 0]
        ids += pieces.trace(text, start, breaks[0], entry, ends[0])
    units = [text[a:b] for a, b in zip(breaks[:-1], breaks[1:], strict=True)]
    numbers = {u: k for k, u in enumerate(dict.fromkeys(units))}
    if units:
        flat, sizes = pieces.encode_words(list(numbers))
        at = np.cumsum(sizes) - sizes
        codes = np.array([numbers[u] for u in units])
        ids += flat[ranges(at[codes], sizes[codes])].tolist()
    return ids + pieces.trace(text, breaks[-1], stop, None, goal)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids (column replaced if there); null ids give null."""
    kept = [c for c in encoded.columns if c != text_col]
    plain = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(plain.schema.fields)).add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [None if k.as_py() is None else decode_ids(pieces, k.as_py()) for k in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return plain.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def token_query(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives
    the text back, for every document. A null text counts as an empty one."""
    out = encode(docs.select("doc_id", "text"), model_path(), chunk, finish=_digests,
                 made="n_ids long, ids_crc32 long, round_trip boolean")
    return out.drop("text")


def _digests(pieces: Pieces, texts: pa.Array, ids: np.ndarray, begins: np.ndarray) -> list[pa.Array]:
    raw = ids.astype("<u4")
    spans = list(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True))
    return [pa.array(np.diff(begins).astype(np.int64)),
            pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in spans], pa.int64()),
            pa.array([decode_ids(pieces, raw[a:b].tolist()) == (t or "")
                      for (a, b), t in zip(spans, texts.to_pylist(), strict=True)], pa.bool_())]
