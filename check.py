"""Compare registered queries with their SQL on the same Parquet files.

    python check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
import traceback

import duckdb

from tabweave.session import local_session
from workload import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def compare(spark, con, sf_dir: str, name: str, df=None) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir) if df is None else df
    got = df.toArrow()
    if name not in ORACLES:
        return True, f"rows only: {got.num_rows}"
    want = con.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    if columns != sorted(got.column_names):
        return False, f"columns {sorted(got.column_names)} != {columns}"
    notes = []
    for c in columns:
        a, b = str(got.schema.field(c).type).replace("large_", ""), str(want.schema.field(c).type).replace("large_", "")
        if a != b:
            notes.append(f"{c}: {a} != {b}")
    rows = [
        sorted(tuple(_value(v) for v in row) for row in zip(*[t.column(c).to_pylist() for c in columns]))
        for t in (got, want)
    ]
    if rows[0] != rows[1]:
        diff = next(((a, b) for a, b in zip(*rows) if a != b), None)
        return False, f"{len(rows[0])} rows vs {len(rows[1])}; first difference {diff} {notes}"
    if notes:
        return False, f"types {notes}"
    return True, f"{len(rows[0])} rows"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(cores=8, **{"spark.driver.memory": "8g"}), connect(sf_dir)
    failed = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:
            ok, note = False, "".join(traceback.format_exception_only(error))[:1500]
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} ({time.time() - start:.1f}s) {note}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
