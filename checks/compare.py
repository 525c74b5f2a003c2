"""Compares the registered queries with their SQL: ``python -m checks.compare DIR [NAME…]``."""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda row: tuple((value is None, str(value)) for value in row),
    )


def difference(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between both results, or None."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    expected = _sorted(names, result.fetchall())
    actual = _sorted(frame.columns, [tuple(row) for row in frame.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows against {len(expected)}"
    for mine, theirs in zip(actual, expected):
        if mine != theirs or list(map(type, mine)) != list(map(type, theirs)):
            return f"{mine} against {theirs}"
    if any(isinstance(v, float) and math.isnan(v) for row in actual for v in row):
        return "not a number"
    return None


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("topicatlas-checks")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, *only: str) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    spark, connection, failures = session(), connect(sf_dir), 0
    for name, run in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            problem = (
                difference(frame, connection, ORACLE[name])
                if name in ORACLE
                else f"rows only: {frame.count()}"
            )
        except Exception as error:  # the report goes on with the next query
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failures += bool(problem and not problem.startswith("rows only"))
        print(f"{name:34} {time.time() - start:6.2f}s  {problem or 'equal'}", flush=True)
    print(f"{failures} differences", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
