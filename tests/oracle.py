"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> tuple[bool, str]:
    result = con.execute(sql)
    want_cols = [d[0] for d in result.description]
    want = rows_of(want_cols, result.fetchall())
    got_cols = spark_df.columns
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    if sorted(want_cols) != sorted(got_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if want != got:
        extra, missing = got - want, want - got
        return False, (f"rows {sum(got.values())} vs {sum(want.values())}; {sum(extra.values())} only in Spark "
                       f"{list(extra)[:2]}; {sum(missing.values())} only in SQL {list(missing)[:2]}")
    return True, f"{sum(got.values())} rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from plumbline.plans import ORACLES, QUERIES
    from plumbline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf)
            ok, note = compare(frame, con, ORACLES[name]) if name in ORACLES else (True, f"rows only: {frame.count()}")
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} ok, {bad} failed")
