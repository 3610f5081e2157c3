"""Run registered queries next to their DuckDB statements and compare all values.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6)) if value != int(value) else str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(plain(v)) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return f"rows-only {len(got)} {took:.2f}s"
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    duck_took = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        only_got = sorted(set(got) - set(want), key=str)[:2]
        only_want = sorted(set(want) - set(got), key=str)[:2]
        return f"FAIL {len(got)} vs {len(want)} rows\n   spark {str(only_got)[:900]}\n   duck  {str(only_want)[:900]}"
    return f"ok {len(got)} rows {took:.2f}s, duck {duck_took:.2f}s"


def main() -> None:
    import __spark_entry__ as entry
    from guardlake.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracle-check",
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        try:
            outcome = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            outcome = f"FAIL {type(error).__name__} {str(error)[:700]}"
        failed += outcome.startswith("FAIL")
        print(f"{name:28s} {outcome}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
