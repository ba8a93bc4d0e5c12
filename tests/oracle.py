"""Run a registered query and its SQL side by side."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows(columns: list[str], records) -> Counter:
    """Multiset of rows with the columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(record[i] for i in order) for record in records)


def spark_result(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows(df.columns, (tuple(r) for r in df.collect()))


def duck_result(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    return sorted(columns), rows(columns, cursor.fetchall())
