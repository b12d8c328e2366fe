"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``covers`` lists the operators it shows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``tidy``: rounded, never minus zero."""
    return (
        f"(CASE WHEN abs({expr}) < {0.5 * 10.0**-digits!r} THEN 0.0 "
        f"ELSE round({expr} + 3e-11, {digits}) END)"
    )


# SQL twins of the adapter views.
POSE = """pose AS (
  SELECT label::BIGINT AS run_id, vec_id, vec_id % 17 <> 0 AS present,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
         embedding::DOUBLE[] AS e
  FROM embeddings)"""
SERIES = """series AS (
  SELECT user_id AS run_id, event_id, ts, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         CASE WHEN event_type <> 'error' THEN value END AS value
  FROM events)"""
STATUS = """status AS (
  SELECT user_id AS run_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         CASE event_type WHEN 'error' THEN 'masked' WHEN 'signup' THEN 'subject_absent'
              ELSE 'ok' END AS inference_status,
         event_type NOT IN ('error', 'signup') AS present,
         event_type = 'click' AS ambiguous,
         event_id % 7 < 4 AS "left", event_id % 5 < 3 AS "right", value AS score
  FROM events)"""
BOXES = """boxes AS MATERIALIZED (
  SELECT l_suppkey AS video_id, l_orderkey % 200 AS frame,
         row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 200 ORDER BY l_orderkey,
           l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS det_id,
         (l_partkey % 1000)::DOUBLE AS x1, ((l_orderkey * 7) % 400)::DOUBLE AS y1,
         (l_partkey % 1000)::DOUBLE + 40 + 3 * l_quantity AS x2,
         ((l_orderkey * 7) % 400)::DOUBLE + 120 + 20 * l_linenumber AS y2,
         1 - l_discount AS score
  FROM lineitem)"""
SPANS = """spans AS (
  SELECT o_custkey AS run_id, o_orderkey AS order_id,
         date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS start_sec,
         date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE + o_orderkey % 90
           AS end_sec
  FROM orders)"""


def joint(j: int, axis: str) -> str:
    """World coordinate of a joint in the ``pose`` view."""
    at = {"x": 3 * j + 3, "y": 3 * j + 1, "z": 3 * j + 2}[axis]
    return f"e[{at}]" if axis == "y" else f"(-e[{at}])"
