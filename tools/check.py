"""Compare registered queries with their SQL counterparts: ``python tools/check.py SF_DIR [name …]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paperlake.session import local_session  # noqa: E402
from workload.oracles import ORACLES  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf)
            columns = sorted(frame.columns)
            got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} rows in {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            rel = con.sql(ORACLES[name])
            shown = ", ".join(f'"{c}"' for c in columns)
            picked = con.sql(f"SELECT {shown} FROM ({ORACLES[name]})")
            assert sorted(rel.columns) == columns, (rel.columns, columns)
            want = picked.fetchall()
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name} (sql): {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        types = dict(frame.dtypes), dict(zip(rel.columns, map(str, rel.types)))
        key = lambda r: tuple((v is None, str(v)) for v in r)
        got.sort(key=key)
        want.sort(key=key)
        ok = got == want
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)} / {len(want)} rows, "
              f"{took:.1f}s, sql {sql_took:.1f}s", flush=True)
        if not ok:
            print("   ", types)
            only = lambda a, b: [r for r in a if r not in set(b)][:3]
            print("    spark only:", str(only(got, want))[:700])
            print("    sql only:  ", str(only(want, got))[:700])
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
