"""Side-by-side comparison of the registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NUMBER = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
          "float": "float", "double": "float", "boolean": "bool", "bool": "bool", "string": "str", "varchar": "str"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if isinstance(v, (list, dict)) else str(v)


def compare(spark, con, folder: str, name: str, query, sql: str | None):
    """(ok, message); rows are compared as multisets of columns sorted by name."""
    started = time.time()
    df = query(spark, folder)
    rows = df.collect()
    seconds = time.time() - started
    if sql is None:
        return (len(rows) > 0, f"{len(rows)} rows (no SQL) {seconds:.1f}s")
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    kinds = dict(zip(names, [str(d[1]).lower() for d in answer.description]))
    expected = answer.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    types = {c: NUMBER.get(t.split("(")[0], t) for c, t in df.dtypes}
    odd = [(c, types[c], kinds[c]) for c in order if NUMBER.get(kinds[c], kinds[c]) not in (types[c], "number")]
    left = sorted(tuple(cell(r[c]) for c in order) for r in rows)
    at = [names.index(c) for c in order]
    right = sorted(tuple(cell(r[i]) for i in at) for r in expected)
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b][:3]
        return False, f"{len(left)} vs {len(right)} rows {order} first differences {diff} {odd}"
    kind_note = f" types {[(c, t, kinds[c]) for c, t in df.dtypes]}" if os.environ.get("SHOW_TYPES") else ""
    return True, f"{len(left)} rows {seconds:.1f}s{kind_note}{' ODD ' + str(odd) if odd else ''}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidewatch.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in queries:
        if not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, folder, name, queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad, "queries:", len(queries), "with SQL:", len(sql))
