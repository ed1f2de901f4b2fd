"""Registered queries against their SQL, and the pipeline against plain versions."""

import check
import plain
import pytest

import corpus_pipeline
from tallyweave.llm.common import read
from tallyweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), check.connect(sf).execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canonical(got) == check.canonical(want)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {f"op{k}" for k in range(1, len(QUERIES) + 1)} == {q.split("_")[0] for q in QUERIES}


def test_pipeline_stages(spark, sf):
    docs = read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = corpus_pipeline.stash(stage(spark, docs, sf))
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert after == before
        elif name == "line_dedup":
            assert after == {d: t for d, (_, _, t) in plain.drop_lines(before).items()}
        elif name == "ngram_join":
            kept = {d for d, (_, c) in plain.jaccard_groups(before, 5, 80).items() if d == c}
            assert after == {d: before[d] for d in kept} and len(kept) < len(before)
        else:
            want = plain.cut_repeats(before, corpus_pipeline.REPEAT_WORDS)
            assert after == {d: kept if n else before[d] for d, (_, n, kept) in want.items()}
        docs = out
