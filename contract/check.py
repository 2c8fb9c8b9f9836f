"""Run contract queries against their DuckDB oracles: python -m contract.check [--sf DIR] [name ...]"""

from __future__ import annotations

import argparse
import datetime
import glob
import os
import signal
import sys
import time
import traceback

import duckdb


def oracle_connection(sf: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def kind(value):
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def compare(spark, con, sf: str, name: str, fn, sql: str | None):
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [node for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if node in plan]
    if bad:
        return False, f"plan has {bad}"
    if sql is None:
        return (True, f"rows={len(got)} (no oracle)") if got else (False, "no rows")
    cur = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != exp_cols:
        return False, f"columns {got_cols} != {exp_cols}"
    if len(got) != len(exp):
        extra, lack = list(set(got) - set(exp))[:2], list(set(exp) - set(got))[:2]
        return False, f"rows {len(got)} != {len(exp)} extra={extra} lack={lack}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        extra, lack = sorted(set(got) - set(exp), key=str), sorted(set(exp) - set(got), key=str)
        return False, f"{len(extra)}/{len(got)} differ {got_cols} spark={extra[:2]} duckdb={lack[:2]}"
    if not got:
        return False, "both empty"
    for col, g, e in zip(got_cols, zip(*got), zip(*exp)):
        kg, ke = {kind(v) for v in g if v is not None}, {kind(v) for v in e if v is not None}
        if kg != ke:
            return False, f"type of {col}: {kg} vs {ke}"
    return True, f"rows={len(got)}"


def main() -> int:
    from mediaquery.session import build_session

    from contract.all import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--limit", type=int, default=40)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.sf)
    names = [n for n in QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = 0
    for name in names:
        began = time.time()
        signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError(name)))
        signal.alarm(args.limit)
        try:
            ok, note = compare(spark, con, args.sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as exc:
            ok, note = False, "".join(traceback.format_exception_only(exc))[:900]
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.2f}s {note}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
