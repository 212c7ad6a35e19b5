"""Run registered queries in Spark and their SQL in DuckDB on the same files and compare all rows.

    python -m loadspark.catalog.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession


def _plain(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def compare(spark: SparkSession, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    """Same column names and the same bag of rows; returns what differs otherwise."""
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = Counter(tuple(_plain(r[n]) for n in names) for r in got.collect())
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    if sorted(theirs) != names:
        return False, f"columns {names} against {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    expected = Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    if rows == expected:
        return True, f"{sum(rows.values())} rows"
    extra, missing = rows - expected, expected - rows
    sample = f"only Spark {list(extra.elements())[:2]} only SQL {list(missing.elements())[:2]}"
    return False, f"{sum(rows.values())}/{sum(expected.values())} rows, {sum(extra.values())} differ: {sample}"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def main() -> int:
    from loadspark.catalog import ORACLES, QUERIES
    from loadspark.session import get_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = get_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                ok, note = compare(spark, con, QUERIES[name], ORACLES[name], args.sf)
            else:
                ok, note = True, f"{QUERIES[name](spark, args.sf).count()} rows, no SQL"
        except Exception as e:  # a broken query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
