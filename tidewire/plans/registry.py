"""The list of checkable queries: a Spark plan and, where one exists, the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The packet view of ``events`` in SQL, column by column as in ``schema.packets_from_events``.
PACKETS_SQL = """packets AS (
  SELECT event_id AS seq, epoch_us(ts) / 8.64e10 AS t,
    CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' WHEN 'purchase' THEN 'ICMP'
      WHEN 'error' THEN 'ARP' ELSE 'Other' END AS protocol,
    'm' || (user_id % 20) AS src_mac, 'm' || (k % 20) AS dst_mac,
    'u' || user_id AS src_ip, 'u' || k AS dst_ip,
    event_type AS src_port, CAST(k AS VARCHAR) AS dst_port, value AS packet_size,
    event_id // 1024 AS batch_id,
    CASE WHEN user_id % 4 = 0 THEN 'benign_0' ELSE 'attack_' || (user_id % 4) END AS file
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use ``{packets}`` for the packet view."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.replace("{packets}", PACKETS_SQL)
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round the double columns (and drop the sign of zero) so that engines can be compared."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            places = special.get(field.name, digits)
            columns.append((F.round(F.col(field.name).cast("double"), places) + F.lit(0.0)).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def r(expression: str, name: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rounded``."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def round_stats(df: DataFrame) -> DataFrame:
    """Rounding for decayed statistics, by the kind of statistic in the column name."""
    return rounded(df, 6, **{c: stat_digits(c) for c in df.columns})


def stat_digits(column: str) -> int:
    for ending, places in STAT_DIGITS.items():
        if column.endswith(ending):
            return places
    return 6


STAT_DIGITS = {
    "_weight": 6,
    "_mean": 5,
    "_std": 3,
    "_magnitude": 5,
    "_radius": 3,
    "_covariance": 4,
    "_pcc": 4,
}

