import numpy as np
import pytest

from tallyweave.llm import whitening as m


def plain(vectors):
    x = np.unique(np.floor(256 * np.array(vectors, np.float64)) + 0.0, axis=0)
    n, mean = len(x), x.mean(axis=0)
    values, parts = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    return x, n, mean, values[::-1], parts[:, ::-1]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, whitened string")


@pytest.mark.parametrize("dim,n", [(16, 500), (3, 100), (40, 30), (1, 20)])
def test_against_plain(spark, dim, n):
    rng = np.random.default_rng(dim)
    scale = np.linspace(3, 0.5, dim)
    vectors = [[float(np.float32(c)) for c in rng.standard_normal(dim) * scale + 5] for _ in range(n)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(n, vectors[0], None), (n + 1, None, None), (n + 2, [float("nan")] * dim, None)]
    out = m.whitening_query(frame(spark, rows).repartition(4)).collect()
    x, count, mean, values, parts = plain(vectors)
    k = min(4, dim)
    assert len(out) == (n + 1) * k and {r["n"] for r in out} == {count}
    sums = [int(s) for s in x.sum(axis=0)]
    z = {c: {} for c in range(1, k + 1)}
    for r in out:
        z[r["component"]][r["vec_id"]] = r["whitened"]
        whole = [int(np.floor(256 * c)) for c in vectors[r["vec_id"] % n]]
        assert r["deviation"] == sum((count * a - s) ** 2 for a, s in zip(whole, sums))
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-10 and r["identity_error"] < 1e-9
    for c in range(1, k + 1):
        want = (np.floor(256 * np.array(vectors)) - mean) @ parts[:, c - 1] / np.sqrt(values[c - 1])
        have = np.array([z[c][i] for i in range(n)])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert z[c][n] == z[c][0]


def test_low_rank_and_equal_values(spark):
    """Two directions only, then equal eigenvalues: no component without variance, any basis of equal ones."""
    flat = [(i, [float(i % 7), float(i % 5), 0.0, 1.0], None) for i in range(70)]
    assert {r["component"] for r in m.whitening_query(frame(spark, flat)).collect()} == {1, 2}
    cross = [(2 * k + s, [float(k == j) * (2 * s - 1) for j in range(5)], None) for k in range(5) for s in range(2)]
    out = m.whitening_query(frame(spark, cross)).collect()
    assert {r["component"] for r in out} == {1, 2, 3, 4} and all(abs(r["explained"] - 0.2) < 1e-12 and r["identity_error"] < 1e-9 for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [1.0, 2.0], None)], [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None), (None, [1.0, 2.0], None)]])
def test_no_variance_gives_no_rows(spark, rows):
    assert m.whitening_query(frame(spark, rows)).count() == 0


def test_mixed_lengths_and_large_values(spark):
    rows = [(i, [float(i), float(i * i % 11), 1e15 * (i % 3)], None) for i in range(30)] + [(99, [1.0, 2.0], None), (None, [1.0, 2.0, 3.0], None)]
    out = m.whitening_query(frame(spark, rows, "double")).collect()
    assert {r["vec_id"] for r in out} == {*range(30), None} and all(r["identity_error"] < 1e-4 for r in out)
    assert any(r["deviation"] is None for r in out)
