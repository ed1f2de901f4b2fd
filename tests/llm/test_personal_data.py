import hashlib
import re

import numpy as np
import pytest

from tallyweave.llm import personal_data as m
from tallyweave.llm.common import read


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    """The base rules in plain Python, with the patterns as given."""
    out = []
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15)}
    for kind, (pattern, valid) in rules.items():
        out += [(kind, *hit.span()) for hit in re.finditer(pattern, text or "") if valid(hit.group())]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = [
    None, "", "no figures", "a@b.c", "a@b.c@d.e x_a@b.c_d@e.f.g-@h.i", "..%@-.-", "@a.b", "a@b", "a@@b.c",
    "1.2.3.4.5.6.7.8", "001.002.003.0004 256.1.1.1 1.256.1.1 0255.0.0.0", "9" * 40 + ".1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 97.51.17.173", "4111111111111111", "4111  111111111111", "79927398713",
    "+1 (578) 555-6437 4918187128635271 é", "+1 (826) 555-4081 190.137.223.204 du", "+12345678", "+123456789)", "+1-2 3(4)5.6 7 8 9 0 1 2 3 4 5 6",
    "日本🙂 mail ü@x.de,x.y+z@mail.example.com 🙂 +49 (30) 1234-5678 🙂", "++1 222 333 4444", "call (212) 555-0100 or write me [at] here [dot] org",
    "a" * 2_000, "1" * 2_000, "1.2.3." * 400, "a@" * 500, "a@b.c " * 300, "+1 " + " " * 1_000 + "2",
]
#: (text, base spans); plain Python takes minutes for these, the rules here must not.
LONG = [("a" * 300_000 + "@", 0), ("1" * 300_000, 0), ("1.2.3." * 40_000, 30_000), ("a@" * 100_000, 0),
        ("a@b.c " * 20_000, 20_000), ("+1 " + " " * 200_000 + "2", 0), ("4111111111111111 x " * 5_000, 5_000)]


def test_base_spans_against_plain(spark, sf):
    texts = ODD + [r["text"] for r in read(spark, sf, "documents").select("text").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in m.personal_data_query(frame).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), (i, (text or "")[:60])
        for kind in m.KINDS:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert set(map(tuple, want)) <= {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)}


def test_long_texts(spark):
    rows = [(i, t) for i, (t, _) in enumerate(LONG)]
    got = {r["id"]: r["n"] for r in m.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr(
        "id", "size(filter(spans, s -> s.base)) AS n").collect()}
    assert got == {i: n for i, (_, n) in enumerate(LONG)}


def test_added_spans(spark):
    """Spans that ran into a neighbour are added; numbers that fail the checksum are not."""
    good = [f"write to x{i}@mail{i % 9}.example.com, call +1 (21{i % 10}) 555-01{i % 90 + 10} now, card 4111111111111111 end." for i in range(60)]
    bad = [f"item 98079157628044{i % 90 + 10} stands here" for i in range(60) if not luhn(f"98079157628044{i % 90 + 10}")]
    run = ["paid +1 (578) 555-6437 4918187128635271 é", "paid 🙂 4111111111111111 97.51.17.173 x", 'token = "4918187128635272"']
    rows = [(i, t) for i, t in enumerate(run + good + bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: [(s["kind"], s["start"], s["end"], s["text"], s["base"]) for s in r["spans"]]
           for r in m.find_personal_data(frame).collect()}
    assert got[0] == [("card", 23, 39, "4918187128635271", False), ("phone", 5, 22, "+1 (578) 555-6437", False)]
    assert got[1] == [("ip", 24, 36, "97.51.17.173", True), ("card", 7, 23, "4111111111111111", False)]
    assert got[2] == []
    assert all(got[len(run) + len(good) + i] == [] for i in range(len(bad)))
    assert all([k for k, *_ in got[3 + i]] == ["email", "card", "phone"] for i in range(60))
    for i, text in rows:
        assert all(text[a:b] == hit for _, a, b, hit, _ in got[i])


def test_estimate_recovers_planted_reliabilities():
    rng = np.random.default_rng(5)
    truth = rng.random(40_000) < 0.6
    rates = np.array([[v.false_yes, v.true_yes] for v in m.LABELERS])
    rates[2] = (0.5, 0.7)  # worse than its prior says
    votes = (rng.random((len(truth), len(rates))) < rates[:, truth.astype(int)].T).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, of, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    belief, found, share = m.estimate(patterns, n.astype(float))
    assert abs(share - 0.6) < 0.03 and np.abs(found - rates).max() < 0.05
    assert ((belief[of.ravel()] > 0.5) == truth).mean() > 0.95


def test_prefix_sums(spark):
    sizes = list(range(1000))
    row = spark.range(1).selectExpr(m._prefix_sums(f"array({str(sizes)[1:-1]})") + " AS x", m._prefix_sums("cast(array() AS array<int>)") + " AS e").first()
    assert row["x"] == list(np.cumsum(sizes)) and row["e"] == []


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (None, "a@b.c", 2), (5, "a@b.c", 3), (5, "a@b.c", 3)]])
def test_odd_tables(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"], r["spans"]) for r in m.personal_data_query(frame).collect()), key=str)
    assert got == sorted([(r[0], "email:0:5" if r[1] else "") for r in rows], key=str)
