"""Where queries are registered, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PRELUDE = """
WITH raw AS (SELECT c_custkey AS subject_id, NULL AS time, 'SEGMENT//' || c_mktsegment AS code, c_acctbal AS numeric_value, NULL AS priority, NULL AS src_id FROM customer
 UNION ALL SELECT o_custkey, o_orderdate, 'ORDER//' || o_orderstatus, o_totalprice, o_orderpriority, o_orderkey FROM orders),
 ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY time NULLS FIRST, src_id NULLS FIRST) - 1 AS BIGINT) AS event_index FROM raw)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prelude: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return register
