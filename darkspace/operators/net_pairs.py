"""Source networks by destination networks, and comparisons of subnets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import mask, network_id, ranges


def pair_counts(packets: DataFrame, networks: Sequence[str], width: int = 8) -> DataFrame:
    """srcnet, dst (place in the list), npkts, nsrcs; a packet counts for every network that holds it."""
    bounds = [ranges([n])[0] for n in networks]
    hits = F.filter(F.array(*(F.when(F.col("daddr").between(a, b), F.lit(k)) for k, (a, b) in enumerate(bounds))), lambda x: x.isNotNull())
    rows = packets.select(network_id(F.col("saddr"), width).alias("srcnet"), "saddr", F.explode(hits).alias("dst"))
    return rows.groupBy("srcnet", "dst").agg(F.count("*").alias("npkts"), F.count_distinct("saddr").alias("nsrcs"))


def nth_value(counts: DataFrame, percent: float) -> DataFrame:
    """npkts and nsrcs at index int(count * percent / 100) of each sorted list (the largest, at 100).

    Rows are counted by value first, so the running sum is over distinct values only.
    """
    index = F.least(F.floor(F.col("total") * percent / 100), F.col("total") - 1)
    places = counts.agg(F.count("*").alias("total")).select(index.alias("i"))
    out = None
    for name in ("npkts", "nsrcs"):
        values = counts.groupBy(name).agg(F.count("*").alias("k"))
        upto = values.withColumn("upto", F.sum("k").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
        found = upto.join(F.broadcast(places)).where(F.col("upto") > F.col("i")).agg(F.min(name).alias(name))  # one row
        out = found if out is None else out.join(F.broadcast(found))
    return out


def rank_band(packets: DataFrame, first: int, last: int, width: int = 24) -> DataFrame:
    """dport, place, net, n: the ports of ranks first to last over all subnets, with each subnet's counts."""
    counts = packets.groupBy("dport").agg(F.count("*").alias("total"))
    top = counts.orderBy(F.desc("total"), "dport").limit(last).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "dport")))
    top = top.where(F.col("place") >= first).select("dport", "place")
    per_net = packets.groupBy("dport", mask(F.col("daddr"), width).alias("net")).agg(F.count("*").alias("n"))
    return per_net.join(F.broadcast(top), "dport").select("dport", "place", "net", "n")  # at most ``last`` rows


def subnet_totals(packets: DataFrame, width: int = 24) -> DataFrame:
    return packets.groupBy(mask(F.col("daddr"), width).alias("net")).agg(F.count("*").alias("n"))
