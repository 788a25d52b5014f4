"""Filtered counts of packets by masked fields in time intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grammar import FIELDS, parse_filter, parse_query, query_columns


def second() -> Column:
    return F.expr("ts_us div 1000000")


def aligned(packets: DataFrame, seconds: int) -> DataFrame:
    """Drops what comes before the first packet whose second is a multiple of ``seconds`` (all, if there is none)."""
    first = packets.where(second() % seconds == 0).agg(F.min("ts_us").alias("first_us"))
    return packets.join(F.broadcast(first), F.col("ts_us") >= F.col("first_us")).drop("first_us")  # one row


def with_interval(packets: DataFrame, interval: int, clock: bool = False) -> DataFrame:
    """Adds ``start``, the first second of a packet's interval, counted from the first packet or (``clock``) from the epoch."""
    sec = second()
    if clock:
        return packets.withColumn("start", sec - sec % interval)
    first = packets.agg(F.expr("min(ts_us) div 1000000").alias("first_sec"))
    return packets.join(F.broadcast(first)).withColumn("start", F.expr(f"first_sec + (ts_us div 1000000 - first_sec) div {interval} * {interval}")).drop("first_sec")


def count_query(
    packets: DataFrame, query: str = "PA", interval: int = 900, top: int | None = None, where: str | None = None, align: int | None = None, clock: bool = False, normalized: bool = False
) -> DataFrame:
    """start, the query's fields, n (and share): counts by masked fields in each interval, the ``top`` largest or all.

    Groups are true groups (a mask before another field doesn't split them);
    ties in n go by the fields. One hash aggregation, combined before the
    shuffle; the rank is a group limit.
    """
    names = [FIELDS[letter] for letter, _ in parse_query(query)]
    rows = packets.where(parse_filter(where)) if where else packets
    if align:
        rows = aligned(rows, align)
    counts = with_interval(rows, interval, clock).select("start", *query_columns(query)).groupBy("start", *names).agg(F.count("*").alias("n"))
    if normalized:
        counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("start")))
    if top is not None:
        place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), *names))
        counts = counts.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
    return counts


def totals(packets: DataFrame, interval: int = 900, where: str | None = None) -> DataFrame:
    """start, n: packets of every interval, empty ones too."""
    rows = packets.where(parse_filter(where)) if where else packets
    counts = with_interval(rows, interval).groupBy("start").agg(F.count("*").alias("n"))
    span = counts.agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a is not null")
    every = span.select(F.explode(F.expr(f"sequence(a, b, {interval}L)")).alias("start"))
    return every.join(counts, "start", "left").select("start", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def total_lines(packets: DataFrame, query: str, interval: int = 900, where: str | None = None) -> DataFrame:
    """The T lines of a query: the packets of every interval; without any packet one line that says so."""
    rows = totals(packets, interval, where)
    none = packets.sparkSession.range(1).select(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))
    none = none.join(F.broadcast(rows.agg(F.count("*").alias("k"))), F.col("k") == 0).select("start", "n")  # one row each
    return rows.union(none).select(F.concat_ws(",", F.lit("T"), F.col("n").cast("string"), F.lit("start_time"), F.col("start").cast("string"), F.lit(query)).alias("line"))


def count_queries(packets: DataFrame, queries: Sequence[str], interval: int = 900, top: int | None = None) -> DataFrame:
    """query, start, key (fields joined by commas), n for several queries over one scan of the packets."""
    rows = with_interval(packets, interval)
    keyed = [F.struct(F.lit(q).alias("query"), F.concat_ws(",", *(c.cast("string") for c in query_columns(q))).alias("key")) for q in queries]
    counts = rows.select("start", F.explode(F.array(*keyed)).alias("q")).groupBy("q.query", "start", "q.key").agg(F.count("*").alias("n"))
    if top is not None:
        place = F.row_number().over(Window.partitionBy("query", "start").orderBy(F.desc("n"), "key"))
        counts = counts.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
    return counts


def to_text(counts: DataFrame, query: str, tag: bool = False) -> DataFrame:
    """The result lines: C (or N with a share), start and the fields, addresses as dotted quads."""
    from ..functions.net import ip_text

    parts = [F.when(F.lit("share" in counts.columns), "N").otherwise("C"), F.format_string("%g", "share") if "share" in counts.columns else F.col("n").cast("string"), F.lit("start_time"), F.col("start").cast("string")]
    for letter, width in parse_query(query):
        name = FIELDS[letter]
        value = ip_text(F.col(name)) if letter in "SD" else F.col(name).cast("string")
        shown = F.concat(value, F.lit(f"/{width}")) if letter in "SD" and 0 < width < 32 else value
        parts += [F.lit(f"{letter}{width or ''}"), shown]
    if tag:
        parts.append(F.lit(query))
    return counts.select(F.concat_ws(",", *parts).alias("line"))
