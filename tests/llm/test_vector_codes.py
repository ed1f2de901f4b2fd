import hashlib

import numpy as np
import pytest

from tallyweave.llm import vector_codes as m


def plain(rows):
    """{id: (code, error)}, {label: error} and the digest, by brute force over Python integers."""
    import math

    good = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(good[0][1])
    cuts = [d * p // 4 for p in range(5)]
    first = sorted(good)[:256]
    books = [[x[cuts[p]:cuts[p + 1]] for _, x, _ in first] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            parts = [x[cuts[p]:cuts[p + 1]] for _, x, _ in good]
            of = [near(part, books[p])[1] for part in parts]
            for e in set(of):
                own = [part for part, k in zip(parts, of) if k == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, labels = [], {}
    for i, x, label in good:
        found = [near(x[cuts[p]:cuts[p + 1]], books[p]) for p in range(4)]
        error = sum(f[0] for f in found)
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
        labels[label] = labels.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[label], digest) for i, code, error, label in out), key=str)


def got(frame):
    return sorted((tuple(r) for r in m.code_query(frame).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def cases():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    many = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + 0.1 * rng.standard_normal(8)], int(i % 3) if i % 7 else None)
            for i in rng.permutation(330)]
    ties = [(i, [float(x) for x in np.array([i % 2, (i // 2) % 2, i % 3, 0]) / 1024], 1) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [nan, 1.0, 1.0, 1.0], 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0, 1.0], 1),
           (None, [1.0, 2.0, 3.0, 4.0], None), (5, [0.1, -0.1, 5.0, 6.0], None), (5, [0.1, -0.1, 5.0, 6.0], None),
           (5, [9.0, 1.0, 5.0, 6.0], 2), (6, [], 2), (7, [1.0] * 5, 2)]
    return {"many": many, "ties": ties, "odd": odd}


@pytest.mark.parametrize("name", list(cases()))
def test_against_plain(spark, name):
    rows = cases()[name]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    if name == "odd":
        rows = [(10 ** 9 if i is None else i, v, label) for i, v, label in rows if v and len(v) == 4]
        want = sorted([((None if i == 10 ** 9 else i), *rest) for i, *rest in plain(rows)], key=str)
    else:
        want = plain(rows)
    assert got(frame) == want


def test_large_components_stay_exact(spark):
    rows = [(i, [1e14 + i * 1e9, 3.0 * i, -1e15, 7e12 * (i % 5)], 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r[0]: r[1] for r in plain(rows)}
    assert {r["vec_id"]: r["code"] for r in m.code_query(frame).collect()} == want


def test_search_prunes_and_agrees():
    rng = np.random.default_rng(4)
    book = np.floor(rng.standard_normal((256, 3)) * 1000)
    book[100:110] = book[5]  # equal entries: the lowest number wins
    queries = np.concatenate([np.floor(rng.standard_normal((6000, 3)) * 1000), book])
    search = m.Search(book)
    number, squares = search.nearest(queries)
    every = m.squared(queries, book)
    assert (number == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()
    assert search.compared < 0.6 * every.size
    exact = m.Search(m.exact_ints(book)).nearest(m.exact_ints(queries[:50]))
    assert (exact[0] == number[:50]).all()


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code string")
    assert m.code_query(frame).count() == 0
