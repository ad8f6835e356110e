"""Compare named queries with their DuckDB texts: names, row counts and values."""
from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return f"{float(v):.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _cell(v.asDict())
    return str(v)


def compare(spark, sf_dir, fn, sql):
    """None when equal, else a short account of the first difference."""
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    con.execute("SET TimeZone='UTC'")
    df = fn(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    order = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    idx = [rel.columns.index(c) for c in order]
    want = sorted(tuple(_cell(r[i]) for i in idx) for r in rel.fetchall())
    if got == want:
        return None if got else "EMPTY (both sides)"
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)} {order}; only spark {extra}; only duckdb {missing}"[:900]


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from queryscope.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pick = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    if os.environ.get("QUERYSCOPE_PLAIN"):  # a session without this package's settings
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config(
            "spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, texts = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        t0 = time.time()
        try:
            if name in texts:
                why = compare(spark, sf, fn, texts[name])
            else:
                n = fn(spark, sf).count()
                why = None if n else "EMPTY"
        except Exception as err:  # report and go on
            why = f"{type(err).__name__}: {str(err)[:700]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in texts else '(rows only)'} {why or ''}", flush=True)
    print("failed:", bad)
