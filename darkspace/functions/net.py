"""Addresses, masks and networks as Column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many ranges become one predicate; more are joined by the upper half of the address.
INLINE_RANGES = 128
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17}


def mask(column: Column, width: int) -> Column:
    """The upper ``width`` of 32 bits; 0 and 32 keep the value."""
    return column if width in (0, 32) else column.bitwiseAND(F.lit(0xFFFFFFFF & ~((1 << (32 - width)) - 1)))


def ip_text(column: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(column, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)))


def ip_number(column: Column) -> Column:
    parts = F.split(column, "[.]")
    return sum((parts[k].cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), parts[0].cast("long") * (1 << 24))


def network_offset(column: Column, width: int) -> Column:
    return column.bitwiseAND(F.lit((1 << (32 - width)) - 1))


def network_id(column: Column, width: int) -> Column:
    return F.shiftright(column, 32 - width)


def slash24(column: Column) -> Column:
    """The first three parts of a dotted quad."""
    return F.substring_index(column, ".", 3)


def protocol_name(column: Column) -> Column:
    named = F.when(column == 1, "icmp").when(column == 6, "tcp").when(column == 17, "udp")
    return named.otherwise(column.cast("string"))


def ranges(networks: Iterable[str]) -> list[tuple[int, int]]:
    """Disjoint sorted [low, high] of CIDR lines; comments, blanks and IPv6 are skipped."""
    found = []
    for line in networks:
        text = line.split("#")[0].strip()
        if text and ":" not in text:
            found.append(ipaddress.ip_network(text, strict=False))
    return [(int(n.network_address), int(n.broadcast_address)) for n in sorted(ipaddress.collapse_addresses(found))]


def range_table(spark: SparkSession, networks: Iterable[str]) -> DataFrame:
    """(prefix, low, high): each range once for every /16 that it meets."""
    rows = [(k, low, high) for low, high in ranges(networks) for k in range(low >> 16, (high >> 16) + 1)]
    return spark.createDataFrame(rows, "prefix long, low long, high long")


def within(column: Column, networks: Iterable[str]) -> Column:
    """Whether an address lies in any of the networks, as one predicate."""
    out = F.lit(False)
    for low, high in ranges(networks):
        out = out | ((column >= low) & (column <= high))
    return out


def member(df: DataFrame, column: str, networks: Iterable[str], keep: bool = True) -> DataFrame:
    """Rows whose address is (``keep``) or isn't in the networks; rows without an address go either way.

    A short list is a pushed-down predicate. A long one is an equi join on the
    upper half of the address with the range as residual condition, which
    hashes instead of comparing every row with every range.
    """
    networks = list(networks)
    rows = df.where(F.col(column).isNotNull())
    if len(ranges(networks)) <= INLINE_RANGES:
        inside = within(F.col(column), networks)
        return rows.where(inside if keep else ~inside)
    table = range_table(df.sparkSession, networks)
    condition = (F.shiftright(rows[column], 16) == table.prefix) & rows[column].between(table.low, table.high)
    return rows.join(table, condition, "left_semi" if keep else "left_anti")


def with_membership(df: DataFrame, column: str, networks: Iterable[str], name: str) -> DataFrame:
    """Adds whether a row's address is in the networks; false for rows without an address. A long list is joined, as in ``member``."""
    networks = list(networks)
    if len(ranges(networks)) <= INLINE_RANGES:
        return df.withColumn(name, F.coalesce(within(F.col(column), networks), F.lit(False)))
    table = range_table(df.sparkSession, networks).withColumnsRenamed({"prefix": "_prefix", "low": "_low", "high": "_high"})
    condition = (F.shiftright(df[column], 16) == table["_prefix"]) & df[column].between(table["_low"], table["_high"])  # ranges are disjoint, so one row at most
    return df.join(table, condition, "left").withColumn(name, F.col("_low").isNotNull()).drop("_prefix", "_low", "_high")
