"""Packets, probes, sweeps and fragments derived from plain business tables, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS = """
SELECT event_id AS pindx,
 CAST((CAST(user_id AS BIGINT)*2654435761) % 4294967296 AS BIGINT) AS saddr,
 CAST(167837696 + (event_id*37) % 4096 AS BIGINT) AS daddr,
 CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 17 WHEN 'signup' THEN 17 ELSE 6 END AS INT) AS proto,
 CAST(1024 + (event_id*7919) % 64511 AS INT) AS sport,
 CAST(CASE event_type WHEN 'error' THEN 8 WHEN 'view' THEN 53 WHEN 'signup' THEN 49152 + (event_id % 64) WHEN 'click' THEN 23 ELSE 443 END AS INT) AS dport,
 CAST(40 + event_id % 1400 AS INT) AS len, CAST(event_id % 65536 AS INT) AS ipid,
 CAST(48 + (user_id + event_id) % 7 AS INT) AS ttl, {epoch} AS ts_us FROM {events}"""

_ROWS = "SELECT *, CAST(row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate) AS BIGINT) AS rn FROM {lineitem}"

PROBES = f"""
SELECT rn AS pindx, CAST(3000000000 + l_suppkey AS BIGINT) AS saddr,
 CAST(167837696 + (l_suppkey % 4)*16 + (l_orderkey*7 + l_linenumber*3 + l_partkey) % 16 AS BIGINT) AS daddr,
 6 AS proto, CAST(1024 + rn % 60000 AS INT) AS sport, 23 AS dport, 40 AS len, CAST(rn % 65536 AS INT) AS ipid,
 CAST(48 + l_partkey % 3 AS INT) AS ttl, 1704067200000000 + rn*20000 AS ts_us FROM ({_ROWS}) t"""

FRAGMENTS = f"""
SELECT rn AS seq, CAST(3000000000 + l_suppkey AS BIGINT) AS saddr, CAST(167837696 + l_partkey % 16 AS BIGINT) AS daddr, 17 AS proto,
 CAST(l_orderkey % 8 AS INT) AS ipid, CAST(8*(l_linenumber-1) AS INT) AS off, CAST(8 + 8*(l_partkey % 2) AS INT) AS plen,
 CASE WHEN l_linenumber < 7 THEN 1 ELSE 0 END AS mf, CAST(l_partkey % 5 AS VARCHAR(8)) AS payload,
 1704067200000000 + rn*20000000 AS ts_us FROM ({_ROWS}) t"""

PLACES = """
SELECT DISTINCT CAST((CAST(c_custkey AS BIGINT)*2654435761) % 4294967296 AS BIGINT) AS saddr, n_name AS country, r_name AS region, c_mktsegment AS city,
 CAST(c_custkey % 40 AS BIGINT) AS asn FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

#: Every 256 events are one source's sweep of a /24; its TTLs follow the 16 x 16 grid in one of four ways, but for some events' users.
SWEEPS = """
SELECT pindx, CAST(3000000000 + k AS BIGINT) AS saddr, CAST(167837696 + 256 * (k % 16) + o AS BIGINT) AS daddr, 6 AS proto, 1024 AS sport, 23 AS dport, 0 AS ipid,
 CAST(50 + CASE WHEN user_id % 211 = 0 THEN 9 WHEN k % 4 = 0 THEN (o div 8 + o) % 2 WHEN k % 4 = 1 THEN (o div 8 + o div 128) % 2 WHEN k % 4 = 2 THEN o div 16 % 2 ELSE user_id % 3 END AS INT) AS ttl,
 1704067200000000 + pindx * 1000 AS ts_us
FROM (SELECT event_id AS pindx, user_id, event_id div 256 AS k, (event_id * 37) % 256 AS o FROM {events})"""

_TABLES = ("events", "lineitem", "customer", "nation", "region", "part", "documents")


def _table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def _spark(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    names = {n: _table(sf_dir, n) for n in _TABLES}
    return spark.sql(text.format(epoch="unix_micros(CAST(ts AS TIMESTAMP))", **names))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, PACKETS, sf_dir)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, PROBES, sf_dir)


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, SWEEPS, sf_dir)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, FRAGMENTS, sf_dir)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, PLACES, sf_dir)


def duck(text: str) -> str:
    """The same tables for SQL that names them directly."""
    return text.format(epoch="epoch_us(ts)", **{n: n for n in _TABLES})
