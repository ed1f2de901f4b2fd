import plain

from tallyweave.llm import line_dedup as m


def test_against_plain(spark):
    docs = {1: "a\nb\nc\nd", 2: "x\nb\nc\nd\ny", 3: None, 4: "", 5: "a\nb", 6: "q\nq\nq\nq\nq", 7: "a\nb\nc\nd",
            8: "\n\n\n", 9: "b\nc\nd\nz\nb\nc\nd", 10: "l\n" * 3000}
    frame = spark.createDataFrame([(k, t, "s", "s") for k, t in docs.items()], "doc_id long, text string, n_lines string, at string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"])
           for r in m.drop_repeated_lines(frame.repartition(4)).collect()}
    assert got == plain.drop_lines(docs)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (None, "k\nl\nm")]
    got = m.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 3), (1, 0), (1, 0)]
    assert m.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_documents_cost_linear_time(spark):
    """200,000 repeated lines in a document: seconds, where a scan per line took half an hour."""
    import time

    lines = [f"line {i}" for i in range(200_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own", *lines[:-1], "new", "x"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in m.drop_repeated_lines(frame).collect()}
    assert time.time() - started < 60
    assert got[1] == (200_000, 0, rows[0][1]) and got[2] == (200_002, 199_999, "own\nnew\nx")
