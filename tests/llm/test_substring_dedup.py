import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from tallyweave.llm import substring_dedup as m


def corpus():
    rng = random.Random(3)
    docs = {}
    for d in range(160):
        letters = "abcdefghijklmnopqrstuvwxyzABCD"[:rng.choice([1, 2, 3, 30])]
        text = " ".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200])))
        other = rng.choice(list(docs.values())) if docs else None
        if other and rng.random() < 0.5:
            text += " x \n" + other[rng.randrange(len(other)):]
        docs[d] = None if d % 50 == 7 else text
    docs[160] = "For " * 4000
    return docs


@pytest.mark.parametrize("rounds,width", [(0, 20), (4, 20), (4, 50), (2, 3)])
def test_against_plain(spark, monkeypatch, rounds, width):
    monkeypatch.setattr(m, "ROUNDS", rounds)
    monkeypatch.setattr(m, "BUCKET_BYTES", 4096)
    docs = corpus()
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"])
           for r in m.cut_repeats(frame.repartition(4), width).collect()}
    assert got == plain.cut_repeats(docs, width)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (None, text), (2, "a b"), (3, None)]
    got = m.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 30), (1, 0), (1, 0), (2, 0), (3, 0)]
    assert m.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean_texts_stay_as_they_are(spark):
    rows = [(1, "two  blanks\n" + " ".join(map(str, range(25))), "s"), (2, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in m.drop_repeats(frame).collect()}
    assert got == {1: rows[0][1], 2: None}


def test_windows_around_a_common_phrase_are_spread(spark):
    """Every text holds one phrase of 16 words between words of its own."""
    phrase = " ".join(f"common{k}" for k in range(16))
    texts = [f"{' '.join(f'a{d}.{k}' for k in range(9))} {phrase} {' '.join(f'b{d}.{k}' for k in range(9))}" for d in range(400)]
    rows = pa.StructArray.from_arrays([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    part = m._Slice(rows, "doc_id", "text", 20)
    _, hashes, bucket, _, _ = part.candidates(8, b"\x01" * len(part.used_anchors()))
    held = np.bincount(bucket, minlength=8)
    assert len(hashes) == 400 * 15 and held.max() < 1.3 * held.mean()
    frame = spark.createDataFrame(list(enumerate(texts)) + [(400, texts[7])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in m.cut_repeats(frame).collect()}
    assert got.pop(400) == 34 and set(got.values()) == {0}


def test_no_table_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    frame = spark.createDataFrame([(1, "a b " * 20), (2, "a b " * 20)], "doc_id long, text string")
    out = m.cut_repeats(frame)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((r["doc_id"], r["n_removed"]) for r in out.collect()) == [(1, 38), (2, 40)]
