"""Run registered queries against their check SQL and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, run, check):
    """(difference or None, number of rows)."""
    df = run(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(check)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine == theirs:
        return None, len(mine[1])
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} <> {theirs[0]}", len(mine[1])
    a, b = set(mine[1]), set(theirs[1])
    return (
        f"rows {len(mine[1])} <> {len(theirs[1])}; only here {sorted(a - b)[:3]}; "
        f"only in check {sorted(b - a)[:3]}"
    ), len(mine[1])


def main(sf_dir: str, names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from workload.queries import REGISTERED

    spark, con = session(), connect(sf_dir)
    for name, (run, check) in REGISTERED.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if check:
                problem, n = compare(spark, con, sf_dir, run, check)
            else:
                problem, n = None, run(spark, sf_dir).count()
        except Exception as error:  # report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {n} rows {time.time() - start:.1f}s {problem or ''}"[:2500], flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
