import random

import numpy as np
import plain
import pytest

from tallyweave.llm import ngram_join as m


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = {}
    for d in range(240):
        base = rng.choice(list(docs.values())) if docs and rng.random() < 0.6 else None
        if base:
            w = base.split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs[d] = " ".join(w)
        else:
            docs[d] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 30, 80, 200])))
    docs[240], docs[241], docs[242] = "A b C", "a B c", "same " * 500
    return docs


@pytest.mark.parametrize("width,percent,tile", [(3, 90, 512), (5, 80, 512), (2, 60, 4)])
def test_against_plain(spark, monkeypatch, width, percent, tile):
    monkeypatch.setattr(m, "TILE", tile)
    docs = corpus()
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, n string")
    got = {r["id"]: (r["n_shingles"], r["component_id"])
           for r in m.jaccard_groups(frame.repartition(3), width, percent).collect()}
    assert got == plain.jaccard_groups(docs, width, percent)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, " \t\n")]
    got = sorted((r["id"] or 0, r["n_shingles"], r["component_id"]) for r in m.jaccard_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(0, 2, 3), (1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (5, 0, 5)]
    assert m.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first_of_group(spark):
    text = " ".join(map(str, range(60)))
    rows = [(4, text, 1), (2, text + " end", 2), (9, "other words here", 3), (7, None, 4)]
    kept = m.keep_first_of_group(spark.createDataFrame(rows, "doc_id long, text string, gone int")).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 7, 9]


def test_keep_first_of_group_repeated_and_null_ids(spark):
    def text(k):
        return " ".join(f"{k}w{i}" for i in range(60))

    schema = "doc_id long, text string, _x int"
    # (5, A) leads A though (5, B) loses to (2, B').
    rows = [(5, text("a"), 1), (7, text("a") + " end", 2), (5, text("b"), 3), (2, text("b") + " end", 4)]
    # Null ids come last, one document of a group stays without any id, repeated rows are one document.
    rows += [(None, text("c"), 5), (9, text("c") + " end", 6), (None, text("d"), 7), (None, text("d") + " end", 8),
             (None, text("d"), 9), (4, text("e"), 11), (4, text("e"), 10), (4, text("e") + " end", 12), (6, text("f"), 14),
             (6, text("f"), 13), (None, text("g"), 16), (None, text("g"), 15)]
    rows += [(None, None, 20), (None, "", 21), (8, " ", 22), (None, text("h"), 23)]
    got = {r["_x"]: (r["doc_id"], r["text"]) for r in m.keep_first_of_group(
        spark.createDataFrame(rows, schema).repartition(3)).collect()}
    d, e = got.keys() & {7, 8}, got.keys() & {10, 12}
    assert len(d) == len(e) == 1
    assert got.keys() - d - e == {1, 4, 6, 13, 15, 20, 21, 22, 23}
    assert all(got[x] == (i, t) for i, t, x in rows if x in got)


@pytest.mark.parametrize("shared", [None, 3])
def test_classes_meet_their_representative_only(spark, monkeypatch, shared):
    # One id, or none, for all rows: a class must not meet the texts of the others.
    met, texts_of = [], m._texts_of

    def counted(docs, classes, width):
        met.append((m._representatives(docs, classes).count(), classes.count()))
        packs = texts_of(docs, classes, width)
        assert {c for r in packs.collect() for c in r["classes"]} == {r["class_id"] for r in classes.collect()}
        return packs

    monkeypatch.setattr(m, "_texts_of", counted)
    docs = {k: t for k, t in corpus().items() if t}
    rows = [(shared, t) for t in docs.values()]
    got = m.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {shared}
    rows_met, live = met[0]
    assert live > 20 and live <= rows_met <= len(rows)


def test_bins_follow_the_replicated_size(spark, monkeypatch):
    # A cluster of near-misses: every set meets every other in the second pass.
    rng = random.Random(3)
    common = [f"c{k}" for k in range(40)]
    docs = {d: " ".join(common + [f"x{d}y{k}" for k in range(16 + rng.randrange(4))]) for d in range(120)}
    docs |= {200 + d: " ".join(common + [f"x{d}y{k}" for k in range(15)]) for d in range(20)}
    docs |= {300 + d: " ".join(f"g{k}" for k in range(1500)) + f" end{d}" for d in range(6)}
    monkeypatch.setattr(m, "TILE", 8)
    monkeypatch.setattr(m, "TILE_TOKENS", 1500, raising=False)
    monkeypatch.setattr(m, "BIN_TOKENS", 3000, raising=False)
    seen, joined = [], m._joined_tiles

    def watched(tiles, width, percent):
        words = tiles.selectExpr("bin", "cluster", "tile", "size(split(text, ' ')) as w")
        seen.append(([r["w"] for r in words.groupBy("bin").sum("w").toDF("bin", "w").collect()],
                     [tuple(r) for r in words.groupBy("cluster", "tile").agg({"w": "sum", "bin": "count"}).collect()]))
        return joined(tiles, width, percent)

    monkeypatch.setattr(m, "_joined_tiles", watched)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_groups(frame, 3, 60).collect()}
    assert got == plain.jaccard_groups(docs, 3, 60)
    assert len(seen) == 2 and sum(seen[1][0]) > 3 * sum(len(t.split()) for t in docs.values())
    # Bins are dealt by hash, so a bin may hold some times its mean.
    assert all(max(bins) < 5 * 3000 for bins, _ in seen)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[:180 + k % 20], rng.integers(0, 2 ** 63, k % 30).astype(np.uint64))))
            for k in range(40)]
    pairs = set(zip(*(v.tolist() for v in m.SignatureTree(sets).pairs(80)), strict=True))
    for a in range(40):
        for b in range(a + 1, 40):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                assert (a, b) in pairs
