"""Run queries and their SQL side by side: ``python -m checks.compare [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import glob
import os
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    given = args.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for path in glob.glob(f"{given.sf}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    bad = []
    for name in given.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, given.sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            seconds = time.time() - start
            if name not in ORACLES:
                print(f"{name:28} {sum(got.values()):7} rows {seconds:6.2f}s  no SQL", flush=True)
                continue
            ran = db.sql(ORACLES[name])
            want = rows_of(ran.columns, ran.fetchall())
            same = sorted(df.columns) == sorted(ran.columns) and got == want
            print(f"{name:28} {sum(got.values()):7} rows {seconds:6.2f}s  {'same' if same else 'DIFFERENT'}", flush=True)
            if not same:
                bad.append(name)
                print("   columns", sorted(df.columns), sorted(ran.columns))
                print("   only here", list((got - want).items())[:3], sum((got - want).values()))
                print("   only SQL ", list((want - got).items())[:3], sum((want - got).values()))
        except Exception as error:  # noqa: BLE001 - reported per query, and the run goes on
            bad.append(name)
            print(f"{name:28} FAILED {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("without query:", sorted(set(ORACLES) - set(QUERIES)), "bad:", bad)


if __name__ == "__main__":
    main()
