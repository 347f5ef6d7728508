"""Strict comparison of a query with its SQL: names, types and every value."""

from __future__ import annotations

import duckdb
import pyarrow as pa

from merchantry.sources.tables import TABLES, table_path


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table_path(directory, name)}'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return f"timestamp tz={t.tz}"
    return str(t)


def _rows(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    types = [(n, _kind(table.schema.field(n).type)) for n in names]
    return types, sorted(zip(*columns, strict=True), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    got_types, got = _rows(df.toArrow())
    wanted_types, wanted = _rows(con.execute(sql).to_arrow_table())
    found = [f"type {a} is not {b}" for a, b in zip(got_types, wanted_types, strict=False) if a != b]
    if len(got_types) != len(wanted_types):
        found.append(f"columns {got_types} are not {wanted_types}")
    if len(got) != len(wanted):
        found.append(f"{len(got)} rows are not {len(wanted)}")
    wrong = [(a, b) for a, b in zip(got, wanted, strict=False) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0][0]} is not {wrong[0][1]}")
    if not got:
        found.append("EMPTY")
    return found
