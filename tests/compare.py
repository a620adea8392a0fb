"""Run registered queries next to their DuckDB text and compare rows, order-insensitively."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def check(spark, con, name, run, sql, sf_dir):
    t = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return "rows-only", len(rows), spent, ""
    t = time.time()
    rel = con.sql(sql)
    left = canonical(df.columns, rows)
    right = canonical(rel.columns, rel.fetchall())
    oracle_s = time.time() - t
    note = f"oracle {oracle_s:.2f}s"
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if kinds != theirs:
        note += f" TYPES {[(c, kinds.get(c), theirs.get(c)) for c in sorted(set(kinds) | set(theirs)) if kinds.get(c) != theirs.get(c)]}"
    if left == right:
        return "ok", len(rows), spent, note
    if left[0] != right[0]:
        return "COLUMNS", len(rows), spent, f"{left[0]} vs {right[0]}"
    ls, rs = set(left[1]), set(right[1])
    return "DIFF", len(rows), spent, f"{len(left[1])} vs {len(right[1])}; spark only {[str(x)[:600] for x in sorted(ls - rs)[:2]]}; duck only {[str(x)[:600] for x in sorted(rs - ls)[:2]]}"


def main():
    import __spark_entry__ as entry
    from feedlake.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="feedlake-compare-"), "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            verdict, n, spent, note = check(spark, con, name, run, sql.get(name), sf_dir)
        except Exception:
            verdict, n, spent, note = "ERROR", 0, 0.0, traceback.format_exc()[-1500:]
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:24s} {verdict:10s} {n:7d} rows {spent:6.2f}s {note}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
