"""Compare registered queries with their SQL in DuckDB, on whole tables.

Run as a script: ``python tests/oracle.py [-s sf_dir] [name prefix ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("postmeter-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v) if isinstance(v, decimal.Decimal) else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "t", str(x)) for x in row)


def compare(spark, con, name: str, sf_dir: str):
    from postmeter.workloads import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in ORACLES:
        return None, f"{len(got)} rows, no SQL"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in rows]
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        return True, f"{len(got)} rows"
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} against {len(want)} rows; {cols}\n   spark {str(only_got)[:900]}\n   sql   {str(only_want)[:900]}"


def main(args: list[str]) -> int:
    from postmeter.workloads import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["-s"]:
        sf_dir, args = args[1], args[2:]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += ok is False
        print({True: "ok  ", False: "BAD ", None: "rows"}[ok], name, f"{time.time() - t:.2f}s", note, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
