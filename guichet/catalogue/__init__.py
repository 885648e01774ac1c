"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The declaration view in SQL, and the same as raw text.
D = """WITH d AS (
  SELECT l_orderkey AS project, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
         l_shipdate AS signed, l_extendedprice AS committed,
         l_extendedprice * (1 - l_discount) AS granted, l_quantity AS quantity, l_tax AS marker,
         l_returnflag AS financing, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_orderpriority AS priority, c_mktsegment AS channel, c_name AS buyer, n_name AS country,
         r_name AS region, p_type AS sector, p_brand AS agency, p_name AS product
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
) """


# Sums of the tables' amounts are checked on so many decimals.
MONEY = 6


def money(c: str, digits: int = 2) -> str:
    """The exact sum of an amount in SQL, as the Spark side rounds it."""
    return f"round(CAST(coalesce(sum(CAST({c} AS DECIMAL(28,6))), 0) AS DOUBLE), {digits})"


def average(c: str, digits: int = 4) -> str:
    return f"round(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / count({c}), {digits})"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add
