"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusaudit.adapters import TABLES  # noqa: E402

KINDS = {
    "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "INTEGER": "int", "HUGEINT": "hugeint",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET threads=4")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((x is None, f"{x:.6g}" if isinstance(x, float) else str(x)) for x in row)


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def compare(df, connection, sql: str) -> str | None:
    """None if rows and types agree, else what differs."""
    result = connection.execute(sql)
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in result.description}
    if kinds != dict(df.dtypes):
        return f"schema: spark {dict(df.dtypes)} sql {kinds}"
    order = sorted(kinds)
    positions = [list(kinds).index(c) for c in order]
    expected = sorted((tuple(row[i] for i in positions) for row in result.fetchall()), key=_key)
    actual = sorted((tuple(row[c] for c in order) for row in df.collect()), key=_key)
    if len(expected) != len(actual):
        extra = set(map(str, actual)) - set(map(str, expected))
        lost = set(map(str, expected)) - set(map(str, actual))
        return f"rows: spark {len(actual)} sql {len(expected)}; extra {[x[:200] for x in sorted(extra)[:3]]} lost {[x[:200] for x in sorted(lost)[:3]]}"
    for a, e in zip(actual, expected):
        if not all(map(_same, a, e)):
            diff = [(c, str(x)[:200], str(y)[:200]) for c, x, y in zip(order, a, e) if not _same(x, y)]
            return f"values: {diff} in {[str(x)[:60] for x in a]}"
    return None


def main() -> None:
    from corpusaudit.catalog import ORACLES, QUERIES
    from corpusaudit.session import build_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false", spark__sql__maxPlanStringLength="5000",
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, connection, ORACLES[name])
                rows = ""
            else:
                problem, rows = None, f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {rows} {problem or ''}", flush=True)
    print("failed", bad, "of", len(chosen))


if __name__ == "__main__":
    main()
