import datetime as dt

from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import inventory, merge, paging, quality, templates, views
from tallyweave.sources import files


def test_every_schema_can_be_read(spark, tmp_path):
    for name, ddl in schemas.TABLES.items():
        path = str(tmp_path / name)
        spark.createDataFrame([], ddl).write.parquet(path)
        assert files.read_table(spark, path, name).count() == 0


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", None, "x"), (2, "b", "k", None)], "id int, name string, unit string, hs string")
    changes = spark.createDataFrame(
        [(1, "a1", "u1", None, 1), (1, "a2", "u2", "y", 2), (3, "c", None, None, 1), (2, None, "z", "h", 1)],
        "id int, name string, unit string, hs string, at int")
    out = merge.merge_upsert(base, changes, ["id"], F.col("at"), keep_if_null=["name"], fill_only=["unit"])
    assert {r.id: (r.name, r.unit, r.hs) for r in out.collect()} == {
        1: ("a2", "u2", "y"), 2: ("b", "k", "h"), 3: ("c", None, None)}
    again = merge.merge_upsert(out, changes, ["id"], F.col("at"), keep_if_null=["name"], fill_only=["unit"])
    assert sorted(again.collect()) == sorted(out.collect()) or again.exceptAll(out).count() == 0


def test_deletes(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, parent int")
    gone = parents.filter("id = 1")
    assert merge.delete_keys(parents, gone).count() == 1
    assert {r.id for r in merge.cascade_delete(children, gone, "parent").collect()} == {11, 12}
    assert {r.id: r.parent for r in merge.cascade_set_null(children, gone, "parent").collect()} == {10: None, 11: 2, 12: None}


def test_versions_and_nesting(spark):
    docs = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id int, previous_version_id int")
    assert {r.id: r.is_latest for r in views.mark_latest(docs).collect()} == {1: False, 2: True, 3: True}
    rows = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 6)], "parent int, pos int, name string")
    nested = views.nest_children(rows, "parent", F.col("pos"), ["pos", "name"], page_size=2).orderBy("page").collect()
    assert [[c.name for c in r.children] for r in nested] == [["l1", "l2"], ["l3", "l4"], ["l5"]]


def test_unmatched_and_pending(spark):
    heads = spark.createDataFrame([(1, True), (2, False)], "id int, is_latest boolean")
    items = spark.createDataFrame(
        [(1, 1, "line_item", None, "a"), (2, 1, "line_item", "", "b"), (3, 1, "line_item", "m", "c"),
         (4, 2, "line_item", None, "d"), (5, 1, "summary", None, "e"), (6, 1, "line_item", None, "")],
        "id int, invoice_id int, row_type string, matched_material_id string, item_name string")
    assert {r.id for r in views.unmatched_items(items, heads).collect()} == {1, 2}
    assert {r.id for r in views.pending_after(items, heads, "invoice_id", F.lit(2)).collect()} == {3, 5, 6}


def test_paging(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, name string")
    order = paging.user_order("name", True, ["id"])
    assert [r.id for r in paging.ordered_page(rows, order, 4).collect()] == [1, 4, 3, 2]
    assert [r.id for r in paging.ordered_page(rows, paging.user_order("name", False, ["id"]), 2, 1).collect()] == [1, 4]
    assert [r.id for r in paging.keyset_page(rows, "id", 1, 2).collect()] == [2, 3]
    assert paging.search_columns(rows, ["name"], "B").count() == 2


def test_quality_report(spark):
    tables = {
        "invoices": spark.createDataFrame([(1, "ok"), (2, "odd")], "id long, parsing_status string"),
        "invoice_items": spark.createDataFrame([(1, 1, "line_item"), (1, 9, "x"), (3, None, "summary")],
                                               "id long, invoice_id long, row_type string"),
    }
    got = {r.rule: r.violations for r in quality.schema_report(tables).collect()}
    assert got["fk:invoice_items.invoice_id"] == 1
    assert got["domain:invoices.parsing_status"] == 1
    assert got["domain:invoice_items.row_type"] == 1
    assert got["unique:invoice_items.id"] == 1
    need = spark.createDataFrame([("a",), ("b",)], "v string")
    assert [r.v for r in quality.missing_values(need, need.filter("v = 'a'"), "v").collect()] == ["b"]


def test_quality_reads_a_table_once(spark, tmp_path):
    spark.createDataFrame(
        [(1, None, "a", "x"), (2, 1, None, "y"), (2, 7, "", "y"), (None, 7, "a", "x"), (None, None, "b", "x")],
        "id long, before int, name string, kind string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = quality.report([
        *quality.orphans("fk", df, "before", df), *quality.repeated("id", df, ["id"]),
        *quality.repeated("pair", df, ["id", "kind"]), *quality.repeated("all", df, ["id", "before", "name"]),
        *quality.outside_domain("kind", df, "kind", ["x"]), *quality.missing({"name": "name"}, df),
        *quality.outside_domain("none", df, "kind", ["x", "y"])])
    assert {r.rule: r.violations for r in out.collect()} == {
        "fk": 2, "id": 2, "pair": 2, "all": 0, "kind": 2, "name": 2, "none": 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Join" not in plan


def test_text_folder_and_export(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes("héllo".encode())
    (folder / "b.md").write_bytes("héllo".encode("latin-1"))
    (folder / "c.txt").write_bytes("héllo".encode())
    (folder / "d.bin").write_bytes(b"x")
    found = files.read_text_folder(spark, str(tmp_path / "in"))
    assert {(r.filename, r.text) for r in found.collect()} == {("a.txt", "héllo"), ("b.md", "héllo"), ("c.txt", "héllo")}
    assert files.read_text_folder(spark, str(tmp_path / "in"), recursive=False).count() == 0
    known = found.filter("filename = 'b.md'").select("file_hash").withColumn("is_latest", F.lit(True))
    assert [r.filename for r in files.new_files(found, known).collect()] == ["a.txt"]
    assert files.pages_of(found).first().text_length == 5
    materials = spark.createDataFrame([("Bolt, big", None, "84")], "name string, category string, hs_code string")
    files.write_catalog(materials.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == "name,category,brand,hs_code,origin_country,unit"
    assert text[1] == '"Bolt, big",,,84,,'
    files.write_catalog(materials, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first().name == "Bolt, big"


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a": "1"}',), ("bad",), (None,)], "j string")
    got = [r.m for r in df.select(files.decode_json(F.col("j"), "map<string,string>").alias("m")).collect()]
    assert got == [{"a": "1"}, {}, {}]
    got = df.select(files.decode_json(F.lit("[1,2]"), "array<bigint>").alias("a")).first().a
    assert got == [1, 2]


def test_sales(spark):
    rows = [("s1", "out", 2.0, 10.0, True, 6.0, 1.0), ("s1", "out", 1.0, 5.0, False, 6.0, 0.0), ("s2", "out", 1.0, 4.0, True, 1.0, 0.0)]
    ledger = spark.createDataFrame(rows, "reference string, movement_type string, quantity double, unit_price double,"
                                         "accepted boolean, applied_cost double, tax double")
    lines = inventory.sale_lines(ledger)
    got = {r.reference: r for r in inventory.sales_totals(lines).collect()}
    assert (got["s1"].subtotal, got["s1"].total_cost, got["s1"].total_amount, got["s1"].total_profit, got["s1"].profit_ex_tax) == (
        20.0, 12.0, 21.0, 9.0, 8.0)
    assert {r.reference for r in inventory.sales_totals(lines, reject="invoice").collect()} == {"s2"}


def test_template_defaults(spark):
    rows = [(1, "a", True, True, dt.datetime(2024, 1, 1)), (2, "a", True, True, dt.datetime(2024, 1, 2)),
            (3, "b", False, True, dt.datetime(2024, 1, 1)), (4, "b", False, True, dt.datetime(2024, 1, 5)),
            (5, "b", True, False, dt.datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "id int, template_type string, is_default boolean, is_active boolean, created_at timestamp")
    df = df.withColumn("updated_at", F.col("created_at"))
    assert {r.template_type: r.id for r in templates.default_templates(df).collect()} == {"a": 2, "b": 4}
    assert {r.id for r in templates.single_default(df).filter("is_default").collect()} == {2, 5}
