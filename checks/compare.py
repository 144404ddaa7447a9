"""Run registered queries next to their SQL text and report differences: python -m checks.compare [sf] [name …]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from checks.oracle import SQL as STUDY_SQL
from checks.oracle_operators import SQL as OPERATOR_SQL
from checks.registry import QUERIES as STUDY
from checks.operators import OPERATORS
from vitalrates.session import build_session


QUERIES = STUDY | OPERATORS
SQL = STUDY_SQL | OPERATOR_SQL


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(columns, rows):
    """Rows with columns in name order, as sorted text; whole doubles and integers print alike."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = canonical(df.columns, df.collect())
    took = time.time() - start
    if name not in SQL:
        return f"rows {len(ours[1]):>8}  {took:6.2f}s  (no SQL)"
    cursor = con.execute(SQL[name])
    theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"COLUMNS {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        mine, expected = set(ours[1]), set(theirs[1])
        only = sorted(mine - expected)[:2]
        other = sorted(expected - mine)[:2]
        return f"DIFF {len(ours[1])} vs {len(theirs[1])} rows, {len(mine - expected)} differ\n  ours   {only}\n  theirs {other}"
    return f"equal {len(ours[1]):>8} rows  {took:6.2f}s"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            report = compare(spark, con, sf_dir, name)
        except Exception as error:
            report = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += not report.startswith(("equal", "rows"))
        print(f"{name:32} {report}", flush=True)
    print("all good" if not bad else f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
