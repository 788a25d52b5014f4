"""Hourly preparation of packets: subnets, scanner classes, hours, gaps, work lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import mask, member, with_membership
from ..plans.grammar import query_columns


def valid_subnets(packets: DataFrame, allowed: Iterable[str], omitted: Iterable[str]) -> DataFrame:
    """Packets to allowed destinations whose sources aren't omitted."""
    return member(member(packets, "daddr", allowed), "saddr", omitted, keep=False)


def with_hour(packets: DataFrame) -> DataFrame:
    return packets.withColumn("hour", F.expr("ts_us div 3600000000 * 3600"))


def hour_counts(packets: DataFrame) -> DataFrame:
    return with_hour(packets).groupBy("hour").agg(F.count("*").alias("n"))


def fill_hours(counts: DataFrame) -> DataFrame:
    """hour, n with 0 for the hours missing between the first and the last."""
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null")
    every = span.select(F.explode(F.expr("sequence(a, b, 3600L)")).alias("hour"))
    return every.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def missing(root: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Keys of ``root`` that ``derived`` lacks: the work still to do."""
    return root.select(key).distinct().join(derived.select(key).distinct(), key, "left_anti")


def destination_subnets(packets: DataFrame, widths: Sequence[int] = (24, 20, 16)) -> DataFrame:
    """Distinct destination networks of several widths, from one scan."""
    nets = F.array(*(F.struct(F.lit(w).alias("width"), mask(F.col("daddr"), w).alias("net")) for w in widths))
    return packets.select(F.explode(nets).alias("x")).select("x.width", "x.net").distinct()


def by_spans(packets: DataFrame, spans: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Packets with the name of every [start, end) span (seconds) that holds them; spans may overlap."""
    names = F.array(*(F.when(F.col("ts_us").between(a * 1_000_000, b * 1_000_000 - 1), F.lit(name)) for a, b, name in spans))
    return packets.withColumn("span", F.explode(F.filter(names, lambda x: x.isNotNull())))


def scanner_trend(packets: DataFrame, scanners: Iterable[str], queries: Sequence[str] = ("PA", "S24", "S", "D"), interval: int = 4000, top: int = 256) -> DataFrame:
    """Counts for all packets, those of acknowledged scanners, and the others, in one job.

    Packets are tagged once, count in two subsets each, and are aggregated
    together; intervals count from the first packet of a subset.
    """
    tagged = with_membership(packets, "saddr", scanners, "known")
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("known"), "ack").otherwise("nack")))
    keys = F.array(*(F.struct(F.lit(q).alias("query"), F.concat_ws(",", *(c.cast("string") for c in query_columns(q))).alias("key")) for q in queries))
    rows = tagged.select(F.expr("ts_us div 1000000").alias("sec"), keys.alias("keys"), subset.alias("subset"))
    first = rows.groupBy("subset").agg(F.min("sec").alias("first"))
    rows = rows.join(F.broadcast(first), "subset").withColumn("start", F.expr(f"first + (sec - first) div {interval} * {interval}"))  # three rows
    counts = rows.select("subset", "start", F.inline("keys")).groupBy("subset", "query", "start", "key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("subset", "query", "start").orderBy(F.desc("n"), "key"))
    return counts.withColumn("_place", place).where(F.col("_place") <= top).drop("_place").select("query", "start", "key", "n", "subset")


def hour_index(packets: DataFrame) -> DataFrame:
    """hour and its place (from 0) among all hours with packets: the shared axis of counts by subnet."""
    hours = with_hour(packets).select("hour").distinct()
    return hours.withColumn("place", (F.row_number().over(Window.orderBy("hour")) - 1).cast("int"))  # hours only


def local_hour_name(seconds: Column, zone: str) -> Column:
    """YYYY-MM-DD-HH of a time in a zone, as hourly files are called."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd-HH")


def write_by_destination(packets: DataFrame, path: str, width: int = 24) -> None:
    """A folder for each destination network; every task writes what it has of each, so a busy network is many files and not one task."""
    packets.withColumn("dst_net", mask(F.col("daddr"), width)).write.partitionBy("dst_net").mode("overwrite").parquet(path)


def write_by_spans(packets: DataFrame, spans: Sequence[tuple[int, int, str]], path: str) -> None:
    """A folder for each span, which may overlap."""
    by_spans(packets, spans).write.partitionBy("span").mode("overwrite").parquet(path)
