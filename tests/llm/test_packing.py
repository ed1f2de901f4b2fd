import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tallyweave.llm import packing as m


def test_ids_of_odd_texts():
    tokenizer = Tokenizer.from_file(m.tokenizer_path())
    texts = ["", None, " ", "  ", "a b", " a b ", "a  b", "a \nb", "a\n b", "\n\n", "it's 'll", "<|endoftext|> x",
             "ñandú 日本 🙂", "a\u00a0 b", "x " * 3000, "\u3000 y", "a\tb c\n", "foo.\n\n bar"]
    ids, begins = m.WordEncoder(m.tokenizer_path())(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[begins[k]:begins[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_packing_is_exact_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = m.pack(docs, m.tokenizer_path(), with_ids=True, shard_pieces=100).collect()
    tokenizer = Tokenizer.from_file(m.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for row in docs.collect():
        found = sorted(pieces[row["doc_id"]], key=lambda r: r["start"])
        whole = [k for r in found for k in r["ids"]]
        assert whole == [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        assert all(r["doc_tokens"] == len(whole) for r in found)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sum(r["length"] for r in rows) > 0.97 * 1024 * len(sequences)


def test_best_fit_against_plain():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 65, rng.integers(0, 60))
        numbers, offsets = m.best_fit(lengths, 64)
        space: list[int] = []
        for at in np.argsort(-lengths, kind="stable"):
            fits = [s for s in space if s >= lengths[at]]
            left = min(fits) if fits else 64
            assert 64 - offsets[at] == left
            if fits:
                space.remove(left)
            if left > lengths[at]:
                space.append(left - lengths[at])
        assert all(np.bincount(numbers, lengths) <= 64) if len(numbers) else True


def test_null_repeated_and_empty(spark):
    rows = [(1, None, 5), (2, "word", 6), (2, "word", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = m.pack(frame, m.tokenizer_path()).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(1, 1), (2, 2), (2, 2)]
    assert m.pack(spark.createDataFrame([], "doc_id long, text string"), m.tokenizer_path()).count() == 0
