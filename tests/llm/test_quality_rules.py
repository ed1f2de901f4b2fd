from collections import Counter

import plain

from tallyweave.llm import quality_rules as m


def test_metrics_against_plain(spark):
    docs = {1: None, 2: "", 3: "a b c d e f g h " * 3, 4: "x # * $ % & | < >\nx\n\nx\n \nx # * $ % & | < >", 5: "ñ 日本 🙂",
            6: " ".join(map(str, range(40))), 7: "w " * 9000, 8: "a\tb\x0bc\x0cd\re"}
    frame = spark.createDataFrame([(k, t, "h", "x") for k, t in docs.items()], "doc_id long, text string, source string, id string")
    got = {r["id"]: r for r in m.quality_metrics(frame.repartition(3)).collect()}
    for d, text in docs.items():
        w = plain.words(text)
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        often = Counter(windows)
        covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if plain.words(x)]
        assert got[d]["n_words"] == len(w) and got[d]["word_chars"] == sum(map(len, w))
        assert got[d]["n_symbols"] == sum((text or "").count(c) for c in m.SYMBOLS)
        assert got[d]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[d]["n_repeat_words"] == len(covered), d


def test_bad_host_is_dropped_and_small_ones_are_shrunk(spark):
    good = " ".join(f"word{k}" for k in range(50))
    bad = "same words come again and again here now " * 20
    rows = [(k, good, f"host{k % 5}") for k in range(200)]
    rows += [(1000 + k, bad if k % 10 else good, "spam") for k in range(100)] + [(2000, good, None), (2001, bad, "tiny"), (2002, good, "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["id"]: r for r in m.judge_quality(frame).collect()}
    assert not any(got[1000 + k]["kept"] for k in range(100)) and got[1000]["host_failed"]
    assert all(got[k]["kept"] for k in range(200)) and got[2000]["kept"] and got[2002]["kept"] and not got[2001]["kept"]
    rates = {r["host"]: r["rate_repeats"] for r in m.host_rates(m.quality_metrics(frame)).collect()}
    assert rates["host1"] < rates["tiny"] < 0.5 < rates["spam"] < 0.9001


def test_empty_table(spark):
    assert m.judge_quality(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
