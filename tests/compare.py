"""Run registered queries beside their SQL in DuckDB and compare values.

usage: python tests/compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(rows):
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """Returns (ok, message, spark seconds)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    took = time.time() - t0
    if sql is None:
        return True, f"rows {len(got)} (no SQL)", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    if [names[i] for i in order] != cols:
        return False, f"columns {cols} vs {sorted(names)}", took
    want = rows_of([tuple(r[i] for i in order) for r in raw])
    got = rows_of([tuple(r) for r in got])
    if got == want:
        return True, f"rows {len(got)}", took
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return False, f"rows {len(got)} vs {len(want)}; first differences {diff}", took


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = [a for a in sys.argv[2:] if a != "-v"]
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from rankspark.plans import catalog
    con = duck(sf_dir)
    sql = catalog.oracle_sql()
    bad = 0
    for name, fn in catalog.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, msg, took = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as exc:
            ok, msg, took = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.1f}s {msg[:900]}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
