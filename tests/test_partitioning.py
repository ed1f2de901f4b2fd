"""What a query shuffles once only: counted in plans that have run."""

import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from tallyweave.operators.partitioning import shared, small_side, unfiltered
from tallyweave.operators.search import bm25_topk
from tallyweave.plans.catalogue import REGISTRY

AUTO = "spark.sql.autoBroadcastJoinThreshold"


@contextmanager
def no_broadcast(spark):
    before = spark.conf.get(AUTO)
    spark.conf.set(AUTO, "-1")
    try:
        yield
    finally:
        spark.conf.set(AUTO, before)


def shuffles(df, key=""):
    """Exchanges that have run, those read again not counted."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    return len(re.findall(rf"^[ :+\-*()0-9|]*Exchange hashpartitioning\({key}", plan, re.MULTILINE))


def test_parts_of_a_query_read_one_shuffle(spark):
    rows = spark.range(40).select((F.col("id") % 7).alias("k"), F.col("id").alias("a"), (-F.col("id")).alias("b"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 1L AS a, 2L AS b"))

    def both(df):
        least = df.groupBy("k").agg(F.min("a").alias("least"))
        return df.filter("a > 3").join(least, "k").select("k", "b", "least")

    with no_broadcast(spark):
        plain = sorted(both(rows).collect())
        dealt = shared(rows, "k")
        assert dealt.columns == rows.columns and sorted(dealt.collect(), key=str) == sorted(rows.collect(), key=str)
        assert sorted(both(dealt).collect()) == plain
        assert (shuffles(both(rows)), shuffles(both(dealt))) == (2, 1)
        held = unfiltered(rows.groupBy("k").agg(F.sum("a").alias("s")))
        assert shuffles(held.filter("k = 1").unionByName(held.filter("k > 5"))) == 1


def test_side_is_broadcast_by_its_measured_size(spark):
    names = spark.createDataFrame([(1, "a" * 100), (2, None)], "k long, name string")
    lines = spark.range(5).withColumnRenamed("id", "k")
    with no_broadcast(spark):
        small = lines.join(small_side(names, most_bytes=148), "k")
        large = lines.join(small_side(names, most_bytes=147), "k")
        assert sorted(small.collect()) == sorted(large.collect()) == [(1, "a" * 100), (2, None)]
        assert (shuffles(small), shuffles(large)) == (0, 2)
        assert small_side(names.limit(0)).count() == 0


def lineitem_shuffles(spark, sf, name):
    """Shuffles of the lines by part, by supplier and by order."""
    with no_broadcast(spark):
        df = REGISTRY[name].plan(spark, sf)
        return [shuffles(df, key) for key in ("l_partkey", "l_suppkey", "l_orderkey")]


def test_price_anomaly_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "price_anomaly")[:2] == [1, 0]


def test_price_anomaly_issues_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "price_anomaly_issues")[:2] == [1, 0]


def test_cross_invoice_duplicates_shuffles_lines_by_part_and_order_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "cross_invoice_duplicates") == [1, 0, 1]


def test_audit_rollup_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "audit_rollup") == [1, 0, 2]


def test_audit_strict_rules_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "audit_strict_rules") == [1, 0, 2]


def test_audit_issue_counts_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "audit_issue_counts") == [1, 0, 2]


def test_full_audit_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "full_audit") == [1, 0, 3]


def test_insights_shuffles_lines_by_part_and_order_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "insights") == [1, 0, 1]


def test_new_reminders_shuffles_lines_by_part_and_order_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "new_reminders") == [1, 0, 1]


def test_price_anomaly_contains_shuffles_lines_by_part_once(spark, sf):
    assert lineitem_shuffles(spark, sf, "price_anomaly_contains")[:2] == [1, 0]


def test_keyword_item_hits_shuffles_no_lines_to_hits(spark, sf):
    with no_broadcast(spark):
        df = REGISTRY["keyword_item_hits"].plan(spark, sf)
        assert [shuffles(df, key) for key in ("l_partkey", "l_suppkey", "item_id")] == [1, 0, 0]


def test_keyword_search_shuffles_a_row_per_document(spark):
    documents = spark.createDataFrame(
        [(1, "red bolt red"), (2, "blue bolt " * 30), (3, None), (4, "gear"), (1, "red bolt red")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red bolt"), (2, "gear gear"), (3, "none")], "query_id long, text string")
    with no_broadcast(spark):
        found = bm25_topk(queries, documents, 5, expand=False)
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()) == [(1, 1, 0), (1, 2, 1), (2, 4, 0)]
        assert shuffles(found, r"doc_id#\d+L?, _length#\d+\b[^,]*,[^,]*\)?") >= 1
        assert shuffles(found, r"doc_id#\d+L?, _length#\d+, term") == 0
        assert shuffles(found, "term") == 2  # distinct words of the queries, and their frequencies
