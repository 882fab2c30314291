"""Collects queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: White space in the dialect of the compared SQL.
W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
