"""Where queries register, and the SQL of the views that their oracles read."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The stand-in views of stockyard.sources.views, for oracles.
VIEWS = {
    "demand": "SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, l_suppkey % 3 AS warehouse, l_quantity AS qty, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS stockout, p_type AS category, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey",
    "sales": "SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS revenue FROM orders",
    "tasks": "SELECT event_id AS task, user_id AS operator, user_id % 3 AS warehouse, CAST(ts AS DATE) AS date, CASE WHEN event_id % 2 = 0 THEN 'Pick' ELSE 'Putaway' END AS task_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error, CAST(value AS DECIMAL(18,4)) AS duration FROM events",
    "series": "SELECT category AS k, date, sum(qty) AS q FROM demand GROUP BY ALL",
    "brand_series": "SELECT brand AS k, date, sum(qty) AS q FROM demand GROUP BY ALL",
    "spine": "SELECT unnest(generate_series((SELECT min(date) FROM demand), (SELECT max(date) FROM demand), INTERVAL 1 DAY))::DATE AS date",
    "dense": "SELECT k, date, coalesce(q, 0) AS q FROM (SELECT DISTINCT k FROM series) CROSS JOIN spine LEFT JOIN series USING (k, date)",
    "brand_dense": "SELECT k, date, coalesce(q, 0) AS q FROM (SELECT DISTINCT k FROM brand_series) CROSS JOIN spine LEFT JOIN brand_series USING (k, date)",
    "sessions": "SELECT l_orderkey AS session, l_partkey AS sku FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_orderkey) BETWEEN 5 AND 15",
}


def _simpson(f: str, top: str, n: int = 4000) -> str:
    """SQL for the integral of f (an expression in u) from 0 to top, by Simpson's rule."""
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({top}) / {3 * n} * list_sum([{weight} * ({f.replace('$u', f'(({top}) * i / {n})')}) for i in range({n + 1})]))"


def normal_cdf(z: str) -> str:
    return f"(0.5 + {_simpson('exp(-0.5 * ($u) ** 2)', z)} / sqrt(2 * pi()))"


def t_two_sided(t: str, df: str) -> str:
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) * {_simpson(f'(1 + ($u) ** 2 / ({df})) ** (-(({df}) + 1) / 2.0)', f'abs({t})')})"


def f_upper(f: str, a: str, b: str) -> str:
    """Upper tail of F with a (at least 2) and b degrees of freedom."""
    front = f"exp(lgamma((({a}) + ({b})) / 2.0) - lgamma(({a}) / 2.0) - lgamma(({b}) / 2.0)) * (({a}) / ({b})::DOUBLE) ** (({a}) / 2.0)"
    inner = f"($u) ** (({a}) / 2.0 - 1) * (1 + ({a}) * ($u) / ({b})) ** (-(({a}) + ({b})) / 2.0)"
    return f"(1 - {front} * {_simpson(inner, f)})"


def with_views(sql: str) -> str:
    """Put the views that a statement names, and those that they name, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                visit(VIEWS[v])
                if v not in need:
                    need.append(v)

    visit(sql)
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in need)
    sql = sql.strip()
    if not head:
        return sql
    if m := re.match(r"(?i)with\s+recursive\s", sql):
        return f"WITH RECURSIVE {head},\n{sql[m.end():]}"
    return f"WITH {head}\n{sql}" if not re.match(r"(?i)with\s", sql) else f"WITH {head},\n{sql[4:].lstrip()}"


def query(name: str, sql: str | None = None, long: str = ""):
    """Register fn(spark, sf_dir) under a name, with the SQL that gives the same rows. long: columns whose counts SQL makes wider than 64 bits."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries called {name}")
        QUERIES[name] = fn
        if sql:
            casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in long.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({with_views(sql)})" if long else with_views(sql)
        return fn

    return add
