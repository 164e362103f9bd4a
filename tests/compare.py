"""Run registered queries next to their SQL and report differences.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        frame[column] = [
            "<null>" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)
            else repr(round(float(v), 6) + 0.0) if isinstance(v, float) or hasattr(v, "is_integer")
            else str(v)
            for v in frame[column].astype(object)
        ]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    left, right = canonical(spark_rows), canonical(sql_rows)
    if list(left.columns) != list(right.columns):
        return f"columns {list(left.columns)} vs {list(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if left.equals(right):
        return None
    bad = (left != right).any(axis=1)
    first = bad.idxmax()
    return f"{bad.sum()} rows differ, first\n   {left.loc[first].to_dict()}\n   {right.loc[first].to_dict()}"


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql, failed = oracle_sql(), 0
    for name, run in queries().items():
        if (names and name not in names) or name not in sql:
            continue
        began = time.time()
        try:
            got = run(spark, folder)
            rows = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns)
            middle = time.time()
            problem = difference(rows, connection.sql(sql[name]).df())
        except Exception as error:  # noqa: BLE001
            middle, problem = time.time(), f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={len(rows)} "
              f"spark={middle - began:.1f} sql={time.time() - middle:.1f} {problem or ''}", flush=True)
    print("missing sql:", sorted(set(queries()) - set(sql)))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
