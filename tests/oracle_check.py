"""Compare registered queries with their oracle SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir, fn, sql):
    """Return (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, oracle {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {
        c: (t, types[c]) for c, t in df.dtypes if _TYPES.get(types[c], types[c].lower()) != t
    }
    if odd:
        note += f" TYPES {odd}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"{note}; {len(got)} vs {len(want)} rows; first differences {diff}"
    return not odd, note


def main(sf: str, names: list[str]) -> int:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from contigloom.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(os.environ.get("ORACLE_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    q, o = e.queries(), e.oracle_sql()
    for name in names or list(q):
        try:
            ok, msg = compare(spark, con, sf_dir, q[name], o.get(name))
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:4000]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name + ": " + msg, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
