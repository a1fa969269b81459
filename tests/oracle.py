"""Compare registered queries with their SQL twins run by DuckDB on the same files.

Run as a script: ``python tests/oracle.py [folder] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return _rows(columns, result.fetchall())


def differences(name, query, sql, spark, folder, con):
    """Empty when both sides agree, else a short account."""
    left_columns, left = spark_rows(query(spark, folder))
    if sql is None:
        return "" if left_columns else f"{name}: no columns"
    right_columns, right = sql_rows(con, sql)
    if left_columns != right_columns:
        return f"{name}: columns {left_columns} against {right_columns}"
    if left != right:
        lost = [r for r in right if r not in left][:2] if len(right) < 5000 else right[:2]
        extra = [r for r in left if r not in right][:2] if len(left) < 5000 else left[:2]
        return f"{name}: {len(left)} rows against {len(right)}; only Spark {extra}; only SQL {lost}"
    return ""


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from shelfmark import registry
    from shelfmark.session import local_session

    registry.load_all()
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(registry.QUERIES)
    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            found = differences(
                name, registry.QUERIES[name], registry.ORACLES.get(name), spark, folder, con
            )
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found = f"{name}: {type(error).__name__} {str(error)[:900]}"
        bad += bool(found)
        kind = "sql" if name in registry.ORACLES else "rows"
        print(f"{'FAIL' if found else 'ok'} {name} {kind} {time.time() - start:.2f}s {found}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
