"""Run registered queries beside their DuckDB oracles and compare values.

    python -m tests.oracle_check [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value: object) -> object:
    """A comparable, type-strict form of one cell."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (decimal.Decimal,)):
        return ("decimal", str(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def normalise(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is not None, type(v).__name__, str(v)) for v in r))
    return [names[i] for i in order], out


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[str, int, float, float]:
    started = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - started
    if sql is None:
        return "rows-only", len(rows), spark_s, 0.0
    started = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    duck_s = time.time() - started
    a, b = normalise(df.columns, rows), normalise(names, expected)
    if a[0] != b[0]:
        return f"COLUMNS {a[0]} vs {b[0]}", len(rows), spark_s, duck_s
    if a[1] != b[1]:
        in_a, in_b = set(a[1]), set(b[1])
        only_a = [r for r in a[1] if r not in in_b][:2]
        only_b = [r for r in b[1] if r not in in_a][:2]
        return f"VALUES {len(a[1])} vs {len(b[1])} rows {a[0]}\n   spark {only_a}\n   duck  {only_b}", len(rows), spark_s, duck_s
    return "ok", len(rows), spark_s, duck_s


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import importlib

    from hindcast.session import build_session

    entry = importlib.import_module("__spark_entry__")
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle-check", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [k for k in queries if not args or k in args or any(a.endswith("*") and k.startswith(a[:-1]) for a in args)]
    bad = 0
    for key in wanted:
        try:
            status, n, a, b = compare(spark, con, sf_dir, queries[key], oracles.get(key))
        except Exception as err:  # noqa: BLE001 - report and go on
            status, n, a, b = f"ERROR {str(err)[:900]}", -1, 0.0, 0.0
        if status not in ("ok", "rows-only") or n == 0:
            bad += 1
            status = status if n else status + " EMPTY"
        print(f"{key:28s} rows={n:<7d} spark={a:6.2f}s duck={b:6.2f}s {status}", flush=True)
    print(f"{len(wanted)} checked, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
