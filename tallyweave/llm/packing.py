"""Packing: best-fit decreasing into windows of tokens, through a tree over free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import ranges, slices, stash

WINDOW = 1024
#: Pieces packed by one task; more pieces mean more shards.
SHARD_PIECES = 20_000
END_ID = 0
#: White space of any script: a blank beside one of these is no safe place to cut.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = f"[{_SPACE}] | [{_SPACE}]"
#: Fixed value: the pattern by which the vocabulary splits texts before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts, working each distinct word out once per slice.

    The byte-level vocabulary splits texts by a pattern in which a single blank between two
    other characters always opens a new part. So ids of the parts between such blanks,
    joined, are the ids of the text; and the distinct parts can be encoded in one go, since
    the bytes of the ids tell where each part ends. The vocabulary file is read as ranks,
    which give the same ids faster. Texts with a blank beside other white space, or that
    hold a special token, are encoded whole by the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = _byte_names()
        ranks = {bytes(shown[c] for c in piece): k for piece, k in self.tokenizer.get_vocab(False).items()
                 if piece not in self.special}
        self.ranks = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, k in ranks.items():
            self.sizes[k] = len(piece)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and the word, for all words, and how many each has."""
        ids = self.ranks.encode_to_numpy(" " + " ".join(words.to_pylist())) if len(words) else np.empty(0, np.uint32)
        ends = np.cumsum(np.asarray(pc.binary_length(words)).astype(np.int64) + 1)
        starts = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        return ids, np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each begins (n + 1)."""
        texts = pc.fill_null(texts, "")
        whole = np.asarray(pc.match_substring_regex(texts, _UNSAFE)).copy()
        for token in self.special:
            whole |= np.asarray(pc.match_substring(texts, token))
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        opens = np.cumsum(counts) - counts
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        plain = coded.dictionary
        odd = np.asarray(pc.or_(pc.equal(plain, ""), pc.match_substring_regex(plain, f"^[{_SPACE}]|[{_SPACE}]$")))
        inner = np.asarray(codes)
        flat, sizes = self._words(plain.filter(pa.array(~odd)))
        place = np.cumsum(~odd) - 1
        alone: list[np.ndarray] = []

        def put(ids: list[int]) -> int:
            alone.append(np.array(ids, np.uint32))
            return len(sizes) + len(alone) - 1

        for k in np.flatnonzero(odd):
            place[k] = put(self.ranks.encode_ordinary(" " + plain[k].as_py()))
        spot = place[inner] if len(inner) else inner
        heads, head_of = np.unique(codes[opens], return_inverse=True)
        first = np.array([put(self.ranks.encode_ordinary(plain[k].as_py())) for k in heads.tolist()], np.int64)
        spot[opens] = first[head_of]
        for k in np.flatnonzero(whole):
            spot[opens[k]] = put(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids)
        sizes = np.concatenate((sizes, np.array([len(x) for x in alone], np.int64)))
        flat = np.concatenate([flat, *alone])
        at = np.cumsum(sizes) - sizes
        ids = flat[ranges(at[spot], sizes[spot])]
        per_text = np.add.reduceat(sizes[spot], opens) if len(opens) else np.empty(0, np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))


def _byte_names() -> dict[str, int]:
    """The characters that byte-level vocabularies show bytes as: printable ones as they
    are, the others by the characters from 256 on, in order."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full windows first, then the rest, each row on its own.

    A piece has doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids. Null
    text is an empty text, whose one piece is the closing id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for part in slices(batches, "text", 4 << 20):
            ids, begins = encode(part.column("text"))
            sizes = np.diff(begins) + 1
            closed = np.full(int(sizes.sum()), END_ID, np.uint32)
            tops = np.cumsum(sizes) - sizes
            closed[ranges(tops, sizes - 1)] = ids
            pieces = -(-sizes // window)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            starts = ranges(np.zeros(len(sizes), np.int64), pieces) * window
            lengths = np.minimum(window, sizes[owner] - starts)
            begin = tops[owner] + starts
            raw = memoryview(closed.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
            columns = [part.column("id").take(pa.array(owner)), pa.array(starts), pa.array(lengths),
                       pa.array(crc, pa.int64()), pa.array(sizes[owner])]
            if with_ids:
                edges = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(closed.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"doc_id {dict(narrow.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long"
    return narrow.mapInArrow(run, schema + ", ids array<long>" * with_ids)


class FreeSpace:
    """A segment tree over the free space 0..window: finds the tightest open window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, space: int, which: int) -> None:
        self.open[space].append(which)
        node = space + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least free space of at least `need`, and that space."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        which = self.open[space].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return which, space


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of every piece, longest first into the tightest open window."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = FreeSpace(window), 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        got = tree.take(need)
        if got is None:
            got, used = (used, window), used + 1
        which, space = got
        numbers[at], offsets[at] = which, window - space
        if space > need:
            tree.put(space - need, which)
    return numbers, offsets


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_pieces: int = SHARD_PIECES,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    Documents are cut into full windows and one shorter rest. A full window is a sequence of
    its own; the rests are dealt to shards of about `shard_pieces` by a hash of their row, and
    each shard is packed by best-fit decreasing. Every id lies in exactly one piece, offsets
    run without gaps. Pieces are written once to the shared folder, so ids of sequences hold
    through retries. Repeated rows are packed each; an empty table gives no piece.
    """
    cut = cut_documents(docs, tokenizer, window, id_col, text_col, with_ids)
    pieces = stash(cut.withColumn("piece_no", F.monotonically_increasing_id()))
    names = cut.columns
    rests = pieces.where(F.col("length") < window)
    shards = max(1, -(-rests.count() // shard_pieces))
    full = pieces.where(F.col("length") == window).select(
        *names, (F.col("piece_no") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["piece_no"]))
        table = table.take(pa.array(order))
        numbers, offsets = best_fit(np.asarray(table["length"]), window)
        shard = np.asarray(table["shard"])
        return table.select(names).append_column(
            "sequence_id", pa.array((shard << 32 | numbers) * 2 + 1)).append_column("offset", pa.array(offsets))

    packed = rests.withColumn("shard", F.pmod(F.xxhash64("piece_no"), F.lit(shards))).groupBy("shard").applyInArrow(
        run, full.schema)
    return full.unionByName(packed)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def packing_query(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path())


def pack_documents(docs: DataFrame) -> DataFrame:
    """The last stage of the pipeline: pieces with their place, digests only."""
    return pack(docs, tokenizer_path())
