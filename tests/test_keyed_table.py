import glob
import os

from pyspark.sql import functions as F

from tallyweave.operators import merge
from tallyweave.operators.keyed_table import KeyedTable
from tallyweave.streaming.indexing import DocumentIndex


def files(path, bucket=None):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/bucket={'*' if bucket is None else bucket}/*.parquet")}


def base(spark, n=200):
    return spark.createDataFrame([(i, f"name{i}", i % 7 if i % 5 else None) for i in range(n)], "id long, name string, parent long")


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable.create(base(spark), str(tmp_path / "t"), ["id"], 16)
    before = files(tmp_path / "t")
    changes = spark.createDataFrame([(3, "new", 1, 1), (3, "newest", 1, 2), (1000, "added", None, 1)],
                                    "id int, name string, parent long, at int")
    touched = table.upsert(changes, F.col("at"))
    assert 1 <= len(touched) <= 2
    after = files(tmp_path / "t")
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched}
    assert kept <= after and not (before - kept) & after
    want = merge.merge_upsert(base(spark), changes, ["id"], F.col("at"))
    assert sorted(map(tuple, table.rows().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert table.upsert(changes, F.col("at")) == touched
    assert sorted(map(tuple, table.rows().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = table._some(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_delete_and_cascade(spark, tmp_path):
    table = KeyedTable.create(base(spark), str(tmp_path / "t"), ["id"], 4)
    table.delete(spark.createDataFrame([(i,) for i in range(100)] + [(5000,)], "id long"))
    assert table.rows().count() == 100
    gone = spark.createDataFrame([(1,), (None,)], "id long")
    table.cascade(gone, "parent")
    assert table.rows().where("parent = 1").count() == 0 and table.rows().where("parent is null").count() == 20
    left = table.rows().count()
    table.cascade(spark.createDataFrame([(2,)], "id long"), "parent", set_null=True)
    assert table.rows().count() == left and table.rows().where("parent = 2").count() == 0
    assert table.upsert(base(spark, 0).withColumn("at", F.lit(1)), F.col("at")) == []
    table.delete(table.rows().select("id"))
    assert table.rows().count() == 0 and files(tmp_path / "t") == set()


def test_document_index_replays_a_batch(spark, tmp_path):
    pages = spark.createDataFrame([(i, i, 1, "x", f"word{i} shared text") for i in range(20)],
                                  "id long, doc_id long, page_no int, page_type string, text string")
    index = DocumentIndex(spark, str(tmp_path / "i"), vectors=lambda c: c.select(
        "id", F.array(F.length("chunk_text").cast("float")).alias("embedding")))
    assert index.chunks().count() == 0
    index.write_batch(pages.where("doc_id < 12"), 0)
    commit = tmp_path / "i" / "keywords" / "commits" / "batch=0"
    names = {n: (commit / n).read_bytes() for n in os.listdir(commit)}
    for n in names:  # the job died before its last write
        os.remove(commit / n)
    assert index.chunks().count() == 0 and index.vector_rows().count() == 0
    index.write_batch(pages.where("doc_id < 12"), 0)
    index.write_batch(pages, 0)  # a replay of a finished batch
    index.write_batch(pages.where("doc_id >= 12"), 1)
    assert index.chunks().count() == index.vector_rows().count() == 20
    assert {r["term"]: r["df"] for r in index.keywords().terms().collect()}["shared"] == 20
    asked = spark.createDataFrame([(1, "word7")], "query_id long, text string")
    assert [r["doc_id"] for r in index.keywords().search(asked, 3).collect()] == ["7:0"]
    assert sorted(map(tuple, index.state().collect())) == [(0, 12, 12, 11), (1, 8, 8, 19)]


def test_rows_without_a_change_stay(spark, tmp_path):
    rows = [(i, "" if i % 2 else None) for i in range(40)]
    table = KeyedTable.create(spark.createDataFrame(rows, "id long, note string"), str(tmp_path / "t"), ["id"], 2)
    table.upsert(spark.createDataFrame([(1, "filled", 1)], "id long, note string, at int"), F.col("at"), fill_only=["note"])
    assert {tuple(r) for r in table.rows().collect()} == {(1, "filled"), *(r for r in rows if r[0] != 1)}
