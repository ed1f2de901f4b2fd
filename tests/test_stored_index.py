import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import search
from tallyweave.operators.stored_index import KeywordIndex
from tallyweave.session import ensure_checkpoint_dir


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, [1 / (r + 1) for r in range(200)], k=rng.randint(0, 60)))) for i in range(n)]
    rows[7] = (7, None)
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("mode", ["any", "all"])
def test_batches_equal_a_full_scan(spark, tmp_path, mode):
    docs = corpus(spark)
    index = KeywordIndex(spark, f"file://{tmp_path}/a", buckets=4, block=16)
    for batch, part in enumerate(("doc_id < 300", "doc_id BETWEEN 300 AND 310", "doc_id > 310")):
        index.append(batch, docs.where(part))
    asked = spark.createDataFrame([(1, "w1 w50 w50"), (2, "w199 w3-w4"), (3, "none"), (4, "w0"), (5, "")], "query_id long, text string")
    want = rows(search.bm25_topk(asked, docs.fillna({"text": ""}), 5, mode=mode))
    assert rows(index.search(asked, 5, mode)) == want and want
    assert rows(index.rebuild(docs, f"file://{tmp_path}/b").search(asked, 5, mode)) == want


def test_blocks_are_skipped_and_buckets_pruned(spark, tmp_path):
    docs = corpus(spark, 3000).unionByName(spark.createDataFrame(
        [(9000 + i, "w1 " * 6 + "rare") for i in range(5)], "doc_id long, text string"))
    index = KeywordIndex(spark, f"file://{tmp_path}/a", buckets=8, block=16)
    index.append(0, docs)
    asked = spark.createDataFrame([(1, "rare w1")], "query_id long, text string")
    plan = index.plan_blocks(asked)
    hits = index.search(asked, 5)
    floor = min(r["score"] for r in hits.collect())
    scored = plan.blocks.where((F.col("before") < 5) | (F.col("bound") >= floor)).count()
    assert scored < 0.2 * plan.blocks.count()
    assert {r["doc_id"] for r in hits.collect()} == {9000 + i for i in range(5)}
    text = plan.score(plan.blocks)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "bucket#" in text.split("PartitionFilters")[1][:200]


def test_a_batch_cut_short_is_invisible_and_a_replay_changes_nothing(spark, tmp_path):
    docs = corpus(spark, 100)
    index = KeywordIndex(spark, f"file://{tmp_path}/a", buckets=2, block=16)
    index.append(0, docs.where("doc_id < 50"))
    before = sorted(map(tuple, index.terms().collect()))
    index.append(1, docs.where("doc_id >= 50"))
    both = sorted(map(tuple, index.terms().collect()))
    commit = tmp_path / "a" / "commits" / "batch=1"
    for name in os.listdir(commit):  # as if the job had died before its last write
        os.remove(commit / name)
    os.rmdir(commit)
    assert sorted(map(tuple, index.terms().collect())) == before
    index.append(1, docs.where("doc_id >= 50"))
    index.append(1, docs)  # the same number again: already committed
    assert sorted(map(tuple, index.terms().collect())) == both
    assert index.batches() == [0, 1]


def test_empty_index(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/a")
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert index.search(asked).count() == 0 and index.terms().count() == 0
    index.append(0, spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(asked).count() == 0


def test_a_cell_returns_the_best_rows_only(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/a", buckets=4, block=16)
    index.append(0, corpus(spark, 3000))
    asked = spark.createDataFrame([(1, "w0"), (2, "w0 w1")], "query_id long, text string")
    plan = index.plan_blocks(asked)
    cells = -(-3000 // 2048)  # cells of 2,048 documents
    assert plan.blocks.agg(F.sum("least")).first()[0] > 2000
    assert plan.score(plan.blocks).count() <= 2 * 60 * cells


def test_repeated_and_null_ids_score_as_one_document(spark, tmp_path):
    docs = [(1, "a b"), (1, "a b"), (1, "a c c"), (None, "a"), (None, "b b a"), (2, "c"), (3, None)]
    index = KeywordIndex(spark, f"file://{tmp_path}/a", buckets=2, block=16)
    index.append(0, spark.createDataFrame(docs, "doc_id long, text string"))
    weights, df, mean = {}, {}, sum(len((t or "").split()) for _, t in docs) / len(docs)
    counts = {}
    for doc, text in docs:
        words = (text or "").split()
        for word in words:
            key = (word, doc, len(words))
            counts[key] = counts.get(key, 0) + 1
    for word, _, _ in counts:
        df[word] = df.get(word, 0) + 1
    for (word, doc, length), tf in counts.items():
        idf = max(math.log((len(docs) - df[word] + 0.5) / (df[word] + 0.5)), 1e-6)
        for query, text in ((1, "a b"), (2, "c")):
            if word in text.split():
                part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
                weights[query, doc] = weights.get((query, doc), 0) + part
    asked = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "a")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in index.search(asked, 5).collect()}
    assert got == pytest.approx(weights, abs=2e-6)


def test_append_keeps_no_copy_of_the_words(spark, tmp_path):
    """Words were written to the checkpoint folder and read again, at several times the size of the texts."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    index = KeywordIndex(spark, f"file://{tmp_path}/a", buckets=2, block=16)
    index.append(0, corpus(spark, 50))
    assert set(os.listdir(folder)) == before
    assert index.terms().agg(F.sum("cf")).first()[0] == index._read("corpus").first()["words"]
