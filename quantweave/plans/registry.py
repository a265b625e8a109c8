"""Queries by name with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Shared SQL tables, each after those that it uses.
TABLES: dict[str, str] = {
    "cells": """SELECT p_brand AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS t,
        sum(l_extendedprice) / sum(l_quantity) AS price,
        sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) / sum(l_quantity) AS flow,
        sum(l_extendedprice) AS cap, sum(l_quantity) AS vol
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "cal": "SELECT t, row_number() OVER (ORDER BY t) - 1 AS t_idx FROM (SELECT DISTINCT t FROM cells)",
    "weekly": """SELECT cal.t, cal.t_idx, a.asset, c.price, c.flow, c.cap, c.vol
        FROM cal CROSS JOIN (SELECT DISTINCT asset FROM cells) a LEFT JOIN cells c ON c.t = cal.t AND c.asset = a.asset""",
    "ret": """SELECT *, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS r,
        flow - lag(flow) OVER w AS q FROM weekly WINDOW w AS (PARTITION BY asset ORDER BY t_idx)""",
    "mcells": """SELECT p_brand AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS t,
        sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "mcal": "SELECT t, row_number() OVER (ORDER BY t) - 1 AS t_idx FROM (SELECT DISTINCT t FROM mcells)",
    "monthly": """SELECT mcal.t, mcal.t_idx, a.asset, c.price
        FROM mcal CROSS JOIN (SELECT DISTINCT asset FROM mcells) a LEFT JOIN mcells c ON c.t = mcal.t AND c.asset = a.asset""",
    "mret": """SELECT *, CASE WHEN lag(price) OVER w > 0 THEN price / lag(price) OVER w - 1 END AS r
        FROM monthly WINDOW w AS (PARTITION BY asset ORDER BY t_idx)""",
    "bars": """SELECT event_type AS ticker, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS ts_bar,
        arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
        FROM events GROUP BY 1, 2""",
}
_NEEDS = {"cal": ["cells"], "weekly": ["cal"], "ret": ["weekly"], "mcal": ["mcells"], "monthly": ["mcal"], "mret": ["monthly"]}


def _chain(name: str) -> list[str]:
    found: list[str] = []
    for x in _NEEDS.get(name, []):
        found += [y for y in _chain(x) if y not in found]
    return [*found, name]


def with_tables(sql: str, *names: str) -> str:
    """`sql` (a SELECT, or more tables and a SELECT after 'WITH') after the shared tables."""
    needed: list[str] = []
    for n in names:
        needed += [x for x in _chain(n) if x not in needed]
    head = ", ".join(f"{n} AS ({TABLES[n]})" for n in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE") else ""
    if body.startswith("WITH"):
        return f"WITH {recursive}{head}, {body.removeprefix('WITH RECURSIVE').removeprefix('WITH').strip()}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Registers a query; without SQL only its rows can be counted."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables) if tables else sql.strip()
        return f

    return register
