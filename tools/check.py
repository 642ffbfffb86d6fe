"""Run registered queries against their SQL on DuckDB and report differences.

    python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidegrid.catalog import all_queries  # noqa: E402
from tidegrid.session import local_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return v


def compare(df, sql: str, con) -> str | None:
    ours = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    a_names, b_names = sorted(ours.column_names), sorted(theirs.column_names)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    types = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in a_names]
    odd = [t for t in types if t[1].replace("large_", "") != t[2].replace("large_", "")]
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} != {theirs.num_rows}"
    rows_a, rows_b = _rows(ours, a_names), _rows(theirs, a_names)
    if rows_a != rows_b:
        bad = [(x, y) for x, y in zip(rows_a, rows_b) if x != y]
        return f"{len(bad)} rows differ, names {a_names}, first:\n   {bad[0][0]}\n   {bad[0][1]}"
    return f"types {odd}" if odd else None


def _rows(table, names):
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--cpus", default="8")
    args.add_argument("names", nargs="*")
    options = args.parse_args()
    spark = local_session(options.cpus)
    con = connect(options.sf)
    failed = 0
    for name, query in all_queries().items():
        if options.names and name not in options.names:
            continue
        began = time.time()
        try:
            df = query.run(spark, options.sf)
            if query.sql is None:
                problem, note = None, f"{df.count()} rows, no SQL"
            else:
                problem, note = compare(df, query.sql, con), f"{df.count() if options.names else ''}"
        except Exception as error:  # report and go on with the next query
            text = str(error) if options.names else str(error)[:600]
            problem, note = f"{type(error).__name__}: {text}", ""
            if options.names:
                traceback.print_exc(limit=6)
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s {note} {problem or ''}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
