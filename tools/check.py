"""Compare registered queries with their SQL in DuckDB: python tools/check.py SF [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tallyweave.plans.catalogue import REGISTRY  # noqa: E402
from tallyweave.session import build_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10] if len(v.isoformat()) < 11 or v.isoformat().endswith(
                "T00:00:00") else v.isoformat()
        if hasattr(v, "item"):
            v = v.item()
        return v

    rows = [tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    q = REGISTRY[name]
    t0 = time.time()
    got = q.plan(spark, sf_dir).toPandas()
    t1 = time.time()
    if q.sql is None:
        return True, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    want = con.execute(q.sql).df()
    t2 = time.time()
    note = f"{len(got)}/{len(want)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{note}; columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        only_a, only_b = len(set(a) - set(b)), len(set(b) - set(a))
        return False, f"{note}; differ: {only_a} only here, {only_b} only there; {diff}"
    return True, note


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session(
        "check", "local[8]", 8, "20g", {"spark.ui.enabled": "false", "spark.log.level": "ERROR"}
    )
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # keep going, report at the end
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
