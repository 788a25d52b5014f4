"""Counts and scans over packets that still arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scans import SCANS, keyed, scan_rows
from ..plans.grammar import parse_filter, query_columns


def with_time(packets: DataFrame, late: str = "2 hours") -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


def stream_counts(packets: DataFrame, query: str = "PA", interval: str = "15 minutes", late: str = "2 hours", where: str | None = None) -> DataFrame:
    """Counts by masked fields in clock intervals; a late packet counts until the watermark passes its interval."""
    rows = with_time(packets.where(parse_filter(where)) if where else packets, late)
    columns = query_columns(query)
    counts = rows.select("ts", *columns).groupBy(F.window("ts", interval), *(c for c in rows.select(*columns).columns)).agg(F.count("*").alias("n"))
    return counts.withColumn("start", F.unix_timestamp("window.start")).drop("window")


def stream_scans(packets: DataFrame, width: int = 24, seconds: float = 120, needed: int | None = None, late: str = "2 minutes") -> DataFrame:
    """Complete scans as they complete; a key without packets for ``seconds`` of event time is forgotten."""
    most_us, needed = int(seconds * 1_000_000), needed or 1 << (32 - width)
    columns = ["ts_us", "pindx", "off", "ttl", "sport", "isn", "ipid"]
    rows = with_time(keyed(packets, width), late).withColumn("isn", F.col("tcp_seq")).select("ts", "saddr", "net", "proto", "dport", *columns)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCANS.split(", ")]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        held = [list(r) for r in state.get[0]] if state.exists else []
        for pdf in batches:
            held += pdf[columns].astype("int64").values.tolist()
        held.sort()
        held = [r for r in held if r[0] >= held[-1][0] - 2 * most_us]
        table = pd.DataFrame(held, columns=columns)
        for k, name in enumerate(("saddr", "net", "proto", "dport")):
            table[name] = key[k]
        found = scan_rows(table, needed, most_us)
        if found:
            ended = max(round((r[8] + r[9]) * 1e6) for r in found)
            held = [r for r in held if r[0] > ended]
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(held[-1][0] // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=names)

    return rows.groupBy("saddr", "net", "proto", "dport").applyInPandasWithState(run, SCANS, "held array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)
