import numpy as np
import plain

from tallyweave.llm import embedding_dedup as m


def test_against_plain(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.4, 0.6])).tolist() for k in range(150)]
    vectors += [vectors[3], vectors[3], None, [0.0] * 16, [float("nan")] * 16, [1.0] + [None] * 15,
                [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0], [-0.0] * 16]
    rows = [(k, v, "x") for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string").repartition(5)
    good = {}
    for k, v in enumerate(vectors):
        a = np.array(v if v else [np.nan], float)
        if np.isfinite(a).all() and (a != 0).any():
            good[k] = np.array(a, np.float32).astype(float)
    groups, links = plain.Groups(range(len(vectors))), dict.fromkeys(range(len(vectors)), 0)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9:
                    groups.join(a, b)
                    links[a] += 1
                    links[b] += 1
    for block in (2048, 16):
        got = {r["id"]: (r["n_links"], r["component_id"], r["kept"])
               for r in m.near_duplicate_vectors(frame, block=block).collect()}
        assert got == {k: (links[k], groups.find(k), groups.find(k) == k) for k in range(len(vectors))}


def test_empty_table_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert m.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    got = m.near_duplicate_vectors(spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (4, [0.0, 1.0])], schema)).collect()
    assert sorted((r["id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 0, 4, True)]


def test_bound_is_rigorous():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 24)), rng.normal(size=(200, 24))
    b[:100] = a[:100] + rng.normal(size=(100, 24)) * 0.5
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]
    cosine = unit[0] @ unit[1].T
    for threshold in (0.2, 0.7, 0.9):
        x, y = m.tile_links(a, b, threshold)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(cosine >= threshold)), strict=True))
