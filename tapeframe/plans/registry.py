"""Where queries and their checking SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Name a checking-SQL view; later views may use earlier ones."""
    VIEWS[name] = sql.strip()


def inline_views(sql: str) -> str:
    """Put every view the statement mentions, directly or not, in its WITH clause."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    parts = [f"{name} AS (\n{VIEWS[name]}\n)" for name in VIEWS if name in needed]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query and, where one exists, the SQL that must return the same rows."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = inline_views(sql)
        return fn

    return register


# Scores sit on short decimal fractions, where the two engines round an exact half
# differently.  Both sides are moved off the half by the same tiny amount.
NUDGE = 1e-9


def sql_round(names, digits: int) -> str:
    return ", ".join(f"round({n} + {NUDGE}, {digits}) AS {n}" for n in names)


def rounded(names, digits: int):
    return [F.round(F.col(n) + NUDGE, digits).alias(n) for n in names]
