"""A registry of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql is DuckDB SQL over the tables."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: DuckDB's view of the order notes (C1): the columns that their texts are made of.
NOTES = """SELECT k, c, s, cents, d, pr, concat('orders/order-', k, '.md') AS path,
 concat('id: ', k, chr(10), 'status: ', s, chr(10), 'cents: ', cents, CASE WHEN k % 5 = 0 THEN '' ELSE concat(chr(10), 'date: ', d) END, chr(10), 'customer: ', c, chr(10), 'tags:', chr(10), '  - ', lower(s), chr(10), '  - ', pr, CASE WHEN k % 4 = 0 THEN concat(chr(10), 'discount: null') ELSE '' END) AS raw,
 concat('# Order ', k, chr(10), chr(10), 'For [[customer-', c, '|the customer]].', chr(10), CASE WHEN k % 10 = 0 THEN concat('See [[missing-', k, ']].', chr(10)) ELSE '' END, chr(10), '## Notes', chr(10), CASE WHEN k % 3 = 0 THEN '' ELSE concat(chr(10), 'Placed on ', d, '.', chr(10)) END) AS body,
 5 + (k % 5 <> 0)::int + (k % 4 = 0)::int AS n_keys, 6 + (k % 10 = 0)::int + 2 * (k % 3 <> 0)::int AS n_lines, 5 + (k % 10 = 0)::int AS notes_line
 FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, cast(round(o_totalprice * 100) AS bigint) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS d, lower(replace(o_orderpriority, ' ', '-')) AS pr FROM orders)"""
