import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tallyweave.llm import piece_tokens as m

PARTS = ["foo", "bar.", " ", "  ", "\n", "it's", "<s>", "ñandú", "日本", "12", "🙂", "aaaa", "the ", "ing", "    ", "▁", "====", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=m.model_path())


def texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice([" ", "", ""]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_library(library):
    found = [*texts(1500), "", None, " ", "a" * 900, "ab" * 500 + " x", "=" * 700, " " * 600]
    ids, begins = m.encode_texts(m.load(m.model_path()), pa.array(found, pa.string()))
    for k, text in enumerate(found):
        assert ids[begins[k]:begins[k + 1]].tolist() == library.encode(text or ""), text


@pytest.mark.parametrize("chunk", [2, 7, 31])
def test_chunks_equal_the_library(spark, library, chunk):
    found = [*texts(60, chunk), "a" * 200, " " * 90, "x" + "=" * 150, None, ""]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(found)], "doc_id long, text string, ids string")
    encoded = m.encode(frame.repartition(3), m.model_path(), chunk)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert got == {k: library.encode(t or "") for k, t in enumerate(found)}


def test_decode_and_query(spark, library):
    found = [*texts(40, 9), None, "", "w " * 40000]
    frame = spark.createDataFrame([*enumerate(found), (3, found[3])], "doc_id long, text string")
    got = m.token_query(frame, 1000).collect()
    assert len(got) == len(found) + 1
    for r in got:
        ids = library.encode(found[r["doc_id"]] or "")
        assert r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["round_trip"] == (library.decode(ids) == (found[r["doc_id"]] or ""))
    rows = spark.createDataFrame([(library.encode("a b 日本"),), (None,)], "ids array<int>")
    assert [r["decoded"] for r in m.decode(rows, m.model_path()).collect()] == ["a b 日本", None]
    assert m.token_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
