"""Side-by-side check of registered queries: Spark result against the SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession


def session(cpus: str = "8", extra: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("daymark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None
                                           else (True, "", 0) for x in r))


def compare(query, spark, con, sf_dir):
    """None when equal, otherwise a short description of the difference."""
    frame = query.frame(spark, sf_dir)
    names = frame.columns
    got = rows_of(names, [tuple(r) for r in frame.collect()])
    if query.sql is None:
        return None if got else "no rows"
    cur = con.execute(query.statement())
    want_names = [c[0] for c in cur.description]
    want = rows_of(want_names, cur.fetchall())
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    if not got:
        return "no rows"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:1]} / {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(names)}): {bad[0][0]} != {bad[0][1]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = session(), duck(sf)
    failed = 0
    for name, q in entry.registered().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(q, spark, con, sf)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:34} {time.time() - t:6.1f}s "
              f"{'rows only' if q.sql is None else ''} {problem or ''}", flush=True)
    print("failed:", failed)
