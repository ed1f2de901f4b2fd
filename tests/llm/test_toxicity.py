import random

import numpy as np
import pyarrow as pa

from tallyweave.llm import toxicity as m


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    names = [f"plain{k}" for k in range(60)]
    docs, labels = [], []
    for d in range(n):
        sentences = [[rng.choice(names) for _ in range(8)] for _ in range(rng.randint(1, 12))]
        toxic = d % 5 == 0
        if toxic:
            rng.choice(sentences)[3] = rng.choice(["Vile,", "nastyful", "nastyous"])
        docs.append((d, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((d, int(toxic)))
    return docs, labels


def test_held_out_and_sentences(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_offending string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = m.toxicity_query(frame, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and len(held) > 80
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    model = m.train(frame.select("doc_id", "text"), marks)
    found = m.offending_sentences(frame, model).collect()
    assert found and all(any(w in r["sentence"].lower() for w in ("vile", "nasty")) for r in found)


def test_noisy_or(spark):
    model = m.Model({"bad": 3.0, "^badly": 1.0}, -2.0)
    text = "Bad thing. all fine\nbadlyer 'BAD'!"
    _, begins, p = m.sentence_scores(pa.array([text]), model)
    z = np.array([1.0, -2.0, -2.0 + 1.0 + 3.0, -2.0])
    assert np.allclose(p, 1 / (1 + np.exp(-z)))
    row = m.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert abs(row["score"] - (1 - np.prod(1 - p))) < 1e-9 and row["worst_sentence"] == 2 and row["n_offending"] == 2


def test_edges(spark):
    schema, marks = "doc_id long, text string", "doc_id long, toxic int"
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (4, "y. " * 20000)], schema)
    none = spark.createDataFrame([], marks)
    got = m.toxicity_query(docs, none).collect()
    assert len(got) == 5 and all(0 <= r["score"] < 0.7 for r in got)
    odd = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None), (8, 0)], marks)
    assert m.toxicity_query(docs, odd).count() == 5
    assert m.toxicity_query(spark.createDataFrame([], schema), odd).count() == 0


def test_what_the_fit_gets_is_bounded(spark):
    """A sampled id repeated many times, and a long text, add at most one bag of `limit` words."""
    long = ". ".join(f"w{k % 7} w{(k + 1) % 7}" for k in range(500))
    docs = spark.createDataFrame([(1, long)] * 300 + [(1, "w1. w2"), (2, "w3 w4. none. w5")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    sample = m.labelled_sample(docs, marks).drop("text").collect()
    assert sorted(r["y"] for r in sample) == [0, 1]
    bags = m._bags(spark.createDataFrame([(1, 1.0, long), (0, 1.0, "w3 w4. none. w5"), (0, 1.0, None)],
                                         "y int, share double, text string"), [f"w{k}" for k in range(7)], 40).to_pylist()
    by = {(r["y"], r["n"]): r for r in bags}
    assert set(by) == {(1, 20), (0, 3), (0, 1)}  # 480 sentences of two words are left out
    assert len(by[1, 20]["word"]) == 40 and len(set(by[1, 20]["sentence"])) == 20
    assert by[0, 3]["word"] == [3, 4, 5] and by[0, 3]["sentence"] == [0, 0, 2]
    assert m._fitted(np.array([0] * 9), np.array([4] * 9), 5).sum() == 5
