"""Run registered queries on Spark and their SQL twins on DuckDB, and compare all rows.

    python -m checks.compare [directory] [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetspan")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fleetspan-compare-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{directory}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return ("nan",)
    return (value is None, type(value).__name__, value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def difference(spark_df, relation) -> str | None:
    """None when both sides hold the same columns and the same rows."""
    left_names, right_names = spark_df.columns, relation.columns
    if sorted(left_names) != sorted(right_names):
        return f"columns differ: {sorted(set(left_names) ^ set(right_names))}"
    left = _rows(left_names, spark_df.collect())
    right = _rows(right_names, relation.fetchall())
    if len(left) != len(right):
        return f"row counts differ: {len(left)} and {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            names = sorted(left_names)
            where = {n: (x[-1], y[-1], x[1], y[1]) for n, x, y in zip(names, a, b) if x != y}
            return f"first different row: {where}"
    return None


def main(argv: list[str]) -> int:
    from checks.registry import QUERIES
    from fleetspan.operators.sizing import release_tables
    from checks.twins import TWINS

    directory = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(directory)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, directory)
            if name in TWINS:
                problem = difference(df, con.sql(TWINS[name]))
                verdict = problem or "equal"
            else:
                problem, verdict = None, f"{df.count()} rows (no twin)"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    release_tables(spark)
    print(f"{len(names) - bad} of {len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
