"""Fragments and their reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("saddr", "daddr", "proto", "ipid")


def with_fragment_fields(packets: DataFrame) -> DataFrame:
    """Adds mf, off (bytes), plen (what follows the IP header, by its length field; -1 if that is too small) and seq, the order.

    ``packets`` come from a capture: ip_off holds flags and offset as on the
    wire. Packets other than first fragments have no ports.
    """
    off = (F.col("ip_off").bitwiseAND(F.lit(0x1FFF)) * 8).cast("int")
    more = F.shiftright("ip_off", 13).bitwiseAND(F.lit(1)).cast("int")
    left = F.col("len") - 4 * F.col("ip_ihl")
    rows = packets.withColumn("off", off).withColumn("mf", more).withColumn("plen", F.greatest(left, F.lit(-1)).cast("int")).withColumn("seq", F.col("pindx"))
    ports = {p: F.when(F.col("off") == 0, F.col(p)).otherwise(0).cast("int") for p in ("sport", "dport")}
    return rows.withColumns(ports)


def only_fragments(packets: DataFrame) -> DataFrame:
    """Fragments, for ``audit`` and the other functions here."""
    return with_fragment_fields(packets).where("mf = 1 or off > 0")


def fragment_lines(packets: DataFrame, only: bool = True, payload: bool = True) -> DataFrame:
    """saddr,daddr,sport,dport,proto,time,plen,ipid,mf,off[,payload in hexadecimal], a line a packet."""
    rows = only_fragments(packets) if only else with_fragment_fields(packets)
    time = F.concat(F.expr("ts_us div 1000000"), F.lit("."), F.lpad(F.pmod("ts_us", F.lit(1_000_000)).cast("string"), 6, "0"))
    parts = [*(F.col(c).cast("string") for c in ("saddr", "daddr", "sport", "dport", "proto")), time, *(F.col(c).cast("string") for c in ("plen", "ipid", "mf", "off"))]
    if payload:
        parts.append(F.lower(F.hex("payload")))
    return rows.select(F.concat_ws(",", *parts).alias("line"))


def audit(fragments: DataFrame) -> DataFrame:
    """For each set of fragments: how many, first and last ones, overlaps, gaps and differing repeats.

    A fragment is held against the one before it by offset (then arrival):
    it overlaps if it begins before the other's end, leaves a gap if after, and
    differs if it overlaps at the same offset with another payload. Sources
    that several files give should have an order (seq) that tells them apart.
    """
    window = Window.partitionBy(*KEY).orderBy("off", "seq")
    rows = fragments.withColumn("p_off", F.lag("off").over(window)).withColumn("p_len", F.lag("plen").over(window)).withColumn("p_payload", F.lag("payload").over(window))
    end = F.col("p_off") + F.col("p_len")
    overlap = F.col("off") < end
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n_frags"),
        F.count_if(F.col("off") == 0).alias("n_first"),
        F.count_if(F.col("mf") == 0).alias("n_last"),
        F.count_if(overlap).alias("n_overlap"),
        F.count_if(F.col("off") > end).alias("n_missing"),
        F.count_if(overlap & (F.col("off") == F.col("p_off")) & (F.col("payload") != F.col("p_payload"))).alias("n_diff"),
    )


def busiest(fragments: DataFrame, column: str, top: int = 10) -> DataFrame:
    return fragments.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)
