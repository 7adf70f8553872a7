"""Run registered queries next to their SQL and compare rows. Usage: python tests/compare.py [sf] [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TESTDATA = "/root/testdata"


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    return normal([c[0] for c in cursor.description], cursor.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return normal(df.columns, df.collect())


def normal(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    ordered = [tuple(row[i] for i in places) for row in rows]
    return [columns[i] for i in places], sorted(ordered, key=repr)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from strandline.session import build_session

    sf_dir = f"{TESTDATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    settings = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", shuffle_partitions=8, **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = oracle(sf_dir), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.perf_counter()
        try:
            ours = spark_rows(run(spark, sf_dir))
            took = time.perf_counter() - began
            theirs = sql_rows(con, sqls[name]) if name in sqls else None
            verdict = "no sql" if theirs is None else "same" if ours == theirs else "DIFFERENT"
            detail = f"{len(ours[1])} rows"
            if verdict == "DIFFERENT":
                detail += f", sql {len(theirs[1])} rows, columns {ours[0]} / {theirs[0]}"
                lines = [p for p in zip(ours[1], theirs[1], strict=False) if p[0] != p[1]][:2]
                detail += "".join(f"\n    {a}\n    {b}" for a, b in lines)
        except Exception as error:  # report and go on with the next query
            took, verdict, detail = time.perf_counter() - began, "ERROR", str(error)[:600]
        failed += verdict in ("DIFFERENT", "ERROR")
        print(f"{name:26} {verdict:10} {took:6.2f}s {detail}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
