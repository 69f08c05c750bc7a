"""Run registered queries against their check SQL in DuckDB.

usage: python tools/check_queries.py SF_DIR [name-substring ...]
"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from tessera.session import build_session


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return ("decimal", str(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, v) for v in r))


def main(sf_dir, wanted):
    spark = build_session("check", f"local[{os.environ.get('BENCH_CPUS', '8')}]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans import QUERIES, SQL

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    bad = []
    for name, fn in QUERIES.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in SQL:
                print(f"{took:6.1f}s {name}: {len(got)} rows, no SQL", flush=True)
                continue
            begin = time.time()
            cur = con.execute(SQL[name])
            columns = [d[0] for d in cur.description]
            want = rows_of(columns, cur.fetchall())
            duck = time.time() - begin
            if sorted(columns) != sorted(df.columns):
                verdict = f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
            elif got != want:
                pairs = [(a, b) for a, b in zip(got, want) if a != b][:2]
                verdict = f"DIFFERENT {len(got)} vs {len(want)} rows {sorted(columns)} e.g. {pairs}"
            else:
                verdict = f"ok {len(got)} rows" + (" EMPTY" if not got else "")
            print(f"{took:6.1f}s duck {duck:5.1f}s {name}: {verdict[:1500]}", flush=True)
            if not verdict.startswith("ok") or not got:
                bad.append(name)
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"{time.time() - start:6.1f}s {name}: FAILED {type(e).__name__} {str(e)[:1800]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
