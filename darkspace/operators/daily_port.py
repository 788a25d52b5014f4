"""The destination port of a day that most source networks seek, and counts of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import mask, ranges
from .ingest import with_hour


def ports_by_sources(packets: DataFrame, width: int = 24, proto: int = 17, top: int | None = 10) -> DataFrame:
    """dport, nsrcs (distinct source networks), npkts, ratio; the ``top`` by sources, then packets."""
    rows = packets.where(F.col("proto") == proto).groupBy("dport").agg(F.count_distinct(mask(F.col("saddr"), width)).alias("nsrcs"), F.count("*").alias("npkts"))
    rows = rows.withColumn("ratio", F.round(F.col("npkts") / F.col("nsrcs"), 6))
    return rows if top is None else rows.orderBy(F.desc("nsrcs"), F.desc("npkts"), "dport").limit(top)


def port_of_day(packets: DataFrame, width: int = 24, proto: int = 17, above: int = 49152, top: int = 10, least_hours: int = 21, hours: Sequence[int] | None = None) -> DataFrame:
    """day, dport, nsrcs, npkts: of a day's ``top`` ports by sources, the one above ``above`` with the fewest packets a source.

    Days with packets of any protocol in fewer than ``least_hours`` hours are
    skipped. Of the others only the ``hours`` of the day count (all, without).
    """
    everything = with_hour(packets).withColumn("day", F.expr("hour div 86400"))
    days = everything.groupBy("day").agg(F.count_distinct("hour").alias("n")).where(F.col("n") >= least_hours).select("day")
    rows = everything.where(F.col("proto") == proto)
    if hours is not None:
        rows = rows.where((F.expr("hour div 3600") % 24).isin(list(hours)))
    ports = rows.groupBy("day", "dport").agg(F.count_distinct(mask(F.col("saddr"), width)).alias("nsrcs"), F.count("*").alias("npkts")).join(days, "day")
    first = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("nsrcs"), F.desc("npkts"), "dport"))
    high = ports.withColumn("k", first).where((F.col("k") <= top) & (F.col("dport") > above))
    second = F.row_number().over(Window.partitionBy("day").orderBy(F.col("npkts") / F.col("nsrcs"), "dport"))
    return high.withColumn("k", second).where("k = 1").select("day", "dport", "nsrcs", "npkts")


def port_of_day_flows(packets: DataFrame, least: int = 49152) -> DataFrame:
    """day, dport, nsrcs: a day's port from ``least`` up with most /24 sources over UDP."""
    rows = packets.where((F.col("proto") == 17) & (F.col("dport") >= least)).withColumn("day", F.expr("ts_us div 86400000000"))
    counts = rows.groupBy("day", "dport").agg(F.count_distinct(F.shiftright("saddr", 8)).alias("nsrcs"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("nsrcs"), "dport"))
    return counts.withColumn("k", place).where("k = 1").drop("k")


def packets_of_daily_port(packets: DataFrame, ports: DataFrame) -> DataFrame:
    """Packets to the port of their own day; ``ports`` has day and dport."""
    rows = packets.withColumn("day", F.expr("ts_us div 86400000000"))
    return rows.join(ports.select("day", "dport"), ["day", "dport"])


def count_sources(packets: DataFrame, network: str) -> DataFrame:
    """nsrcs and npkts to one network."""
    low, high = ranges([network])[0]
    return packets.where(F.col("daddr").between(low, high)).agg(F.count_distinct("saddr").alias("nsrcs"), F.count("*").alias("npkts"))


def sources_per_hour(packets: DataFrame) -> DataFrame:
    return with_hour(packets).groupBy("hour", "saddr").agg(F.count("*").alias("n"))


def merge_counts(*tables: DataFrame, label: str = "label") -> DataFrame:
    """Sums of n by label over several tables."""
    out = tables[0].select(label, "n")
    for t in tables[1:]:
        out = out.unionByName(t.select(label, "n"))
    return out.groupBy(label).agg(F.sum("n").alias("n"))


def cumulative_sources(packets: DataFrame) -> DataFrame:
    """hour, new, seen: sources first seen in an hour, and those seen so far (a running sum over hours only)."""
    hours = with_hour(packets).select("hour").distinct()
    new = with_hour(packets).groupBy("saddr").agg(F.min("hour").alias("hour")).groupBy("hour").agg(F.count("*").alias("new"))
    rows = hours.join(new, "hour", "left").select("hour", F.coalesce("new", F.lit(0)).cast("long").alias("new"))
    return rows.withColumn("seen", F.sum("new").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_counts(packets: DataFrame) -> DataFrame:
    """hour, saddr, n, total: a source's packets so far at each hour in which it is seen."""
    window = Window.partitionBy("saddr").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return sources_per_hour(packets).withColumn("total", F.sum("n").over(window))
