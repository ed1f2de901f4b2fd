import pytest

from tallyweave.operators.versions import VersionStore, version_chains

SCHEMA = "id long, previous_version_id long, name string"


def test_chains_of_any_length(spark):
    long = [(i, i - 1 if i else None, "a") for i in range(37)]
    rows = long + [(100, None, "b"), (101, 100, "b"), (102, 100, "b"), (200, 999, "c"), (201, 200, "c")]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in version_chains(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: (0, i) for i in range(37)} | {100: (100, 0), 101: (100, 1), 102: (100, 1), 200: (200, 0), 201: (200, 1)}
    assert got == want
    with pytest.raises(ValueError, match="ring"):
        version_chains(spark.createDataFrame([(1, 2, "x"), (2, 1, "x")], SCHEMA))
    assert version_chains(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store_moves_replaced_versions_and_prunes(spark, tmp_path):
    store = VersionStore.create(spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, None, "b")], SCHEMA), str(tmp_path / "s"), 4)
    batch = spark.createDataFrame([(4, 2, "a"), (5, 4, "a"), (6, None, "c")], SCHEMA)
    touched = store.insert(batch)
    state = {r["id"]: r["is_latest"] for r in store.rows().collect()}
    assert state == {1: False, 2: False, 3: True, 4: False, 5: True, 6: True} and len(touched) <= 4
    store.insert(batch)  # a replay
    assert {r["id"]: r["is_latest"] for r in store.rows().collect()} == state and store.rows().count() == 6
    plan = store.rows().where("is_latest")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_latest" in plan
