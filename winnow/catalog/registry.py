"""Registration of queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Named sub-queries that a SQL twin may use.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(texts) -> str:
    return "(" + ", ".join(sql_text(t) for t in texts) + ")"


def with_parts(sql: str, own: dict[str, str] | None = None) -> str:
    """Prefix the named sub-queries that ``sql`` uses, directly or through others. ``own`` replaces some."""
    texts = {**PARTS, **(own or {})}
    chain: dict[str, str] = {}

    def need(text: str, by: str | None = None) -> None:
        for name in texts:
            if name != by and name not in chain and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                need(texts[name], name)
                chain[name] = f"{name} AS ({texts[name]})"

    need(sql)
    if not chain:
        return sql.strip()
    prefix = "WITH RECURSIVE " + ",\n".join(chain.values())
    rest = re.match(r"WITH (?:RECURSIVE )?(.*)", sql.strip(), re.DOTALL)
    return f"{prefix},\n{rest.group(1)}" if rest else f"{prefix}\n{sql.strip()}"


def query(key: str, sql: str | None = None, own: dict[str, str] | None = None):
    """Register ``fn(spark, folder)`` under ``key``, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_parts(sql, own)
        return fn

    return add
