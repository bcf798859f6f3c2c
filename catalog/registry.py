"""The list of queries and the SQL that says what each one has to return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.tables import SQL_TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` is the check; ``uses`` names the derived tables it starts from.
    """

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from catalog.tables import Tables

            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql, uses.split())
        return fn

    return register


def with_tables(sql: str, names: list[str]) -> str:
    """Put the SQL of the derived tables in front, dependencies first."""
    wanted: list[str] = []

    def add(name: str) -> None:
        needs, _ = SQL_TABLES[name]
        for n in needs:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL_TABLES[n][1]})" for n in wanted]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            body = body[len(head):]
            return "WITH RECURSIVE " + ", ".join(ctes + [body])
    return ("WITH RECURSIVE " + ", ".join(ctes) + "\n" if ctes else "") + body


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with a negative zero turned into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)
