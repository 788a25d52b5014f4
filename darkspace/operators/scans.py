"""Complete horizontal scans: every address of a network probed within a time."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import mask, network_offset

SCANS = (
    "src long, dst long, proto int, dport int, cov int, cnt int, inv int, true_inv int, start double, elapsed double, "
    "offs array<long>, ttls array<long>, sports array<long>, isns array<long>, ipids array<long>, times array<double>"
)
ARRAYS = ("off", "ttl", "sport", "isn", "ipid")
#: Probes of a scan up to which plain loops are faster than arrays.
SHORT = 200


def exchange_inversions(values: list[int]) -> int:
    """Swaps of an exchange sort; the number of inversions where no value repeats.

    In each round the first place takes ever smaller values of those behind
    it, and each of their places the one before: a running minimum.
    """
    swaps = 0
    if len(values) <= SHORT:
        a = list(values)
        for k in range(len(a) - 1):
            least = a[k]
            for j in range(k + 1, len(a)):
                if a[j] < least:
                    least, a[j], swaps = a[j], least, swaps + 1
        return swaps
    a = np.array(values)
    for k in range(len(a) - 1):
        least = np.minimum.accumulate(a[k:])
        places = k + 1 + np.flatnonzero(a[k + 1 :] < least[:-1])
        if len(places):
            swaps += len(places)
            a[places] = least[places - k - 1]
    return swaps


def inversions(values: list[int]) -> int:
    """Pairs of which the first is larger, by insertion into the sorted values before."""
    before: list[int] = []
    found = 0
    for v in values:
        found += len(before) - bisect_right(before, v)
        insort(before, v)
    return found


def complete_scans(times: list[int], offsets: list[int], needed: int, most_us: int):
    """(first, last) rows of each scan: at a packet that completes the offsets within ``most_us``; then all starts anew."""
    first, seen = 0, {}
    for k, off in enumerate(offsets):
        seen[off] = seen.get(off, 0) + 1
        if len(seen) < needed:
            continue
        while times[first] < times[k] - most_us:
            seen[offsets[first]] -= 1
            if not seen[offsets[first]]:
                del seen[offsets[first]]
            first += 1
        if len(seen) >= needed:
            yield first, k
            first, seen = k + 1, {}


def scan_rows(rows: pd.DataFrame, needed: int, most_us: int) -> list[tuple]:
    """Scans of one key's packets, sorted by time."""
    times, offsets = rows["ts_us"].tolist(), rows["off"].tolist()
    found = list(complete_scans(times, offsets, needed, most_us))
    if not found:
        return []
    arrays = [rows[name].tolist() for name in ARRAYS]
    head = [int(rows[c].iloc[0]) for c in ("saddr", "net", "proto", "dport")]
    out = []
    for a, b in found:
        offs, start = offsets[a : b + 1], times[a]
        took = [(t - start) // 1000 / 1000 for t in times[a : b + 1]]
        out.append((*head, len(set(offs)), len(offs), exchange_inversions(offs), inversions(offs), start / 1e6, (times[b] - start) / 1e6, *(x[a : b + 1] for x in arrays), took))
    return out


def keyed(packets: DataFrame, width: int) -> DataFrame:
    rows = packets.withColumn("net", mask(F.col("daddr"), width)).withColumn("off", network_offset(F.col("daddr"), width))
    return rows if "tcp_seq" in packets.columns else rows.withColumn("tcp_seq", F.lit(0).cast("long"))


def horizontal_scans(packets: DataFrame, width: int = 24, seconds: float = 120, needed: int | None = None) -> DataFrame:
    """Scans by source, destination network, protocol and port.

    A scan lies within the ``seconds`` up to its last packet, so only packets
    in such a time with ``needed`` packets or more are kept. They are cut where
    nothing arrives for ``seconds``: no scan spans such a gap. Stretches that
    can't cover the network are dropped before Python sees them, so a busy
    source costs only its candidate stretches.
    """
    most_us, needed = int(seconds * 1_000_000), needed or 1 << (32 - width)
    key = ("saddr", "net", "proto", "dport")
    order = Window.partitionBy(*key).orderBy("ts_us", "pindx")
    rows = keyed(packets, width).select(*key, "off", "ts_us", "pindx", "ttl", "sport", F.col("tcp_seq").alias("isn"), "ipid")
    time = Window.partitionBy(*key).orderBy("ts_us")
    dense = F.count("*").over(time.rangeBetween(-most_us, 0)) >= needed
    rows = rows.withColumn("dense", F.when(dense, F.lit(1))).withColumn("dense", F.max("dense").over(time.rangeBetween(0, most_us)))
    rows = rows.where("dense = 1").drop("dense")
    gap = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(order) > most_us, F.lit(True))
    rows = rows.withColumn("gap", gap.cast("long")).withColumn("stretch", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy(*key, "stretch")
    rows = rows.withColumn("_offsets", F.size(F.collect_set("off").over(stretch))).where(F.col("_offsets") >= needed).drop("gap", "_offsets")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = scan_rows(pdf.sort_values(["ts_us", "pindx"]), needed, most_us)
        return pd.DataFrame(found, columns=[c.split()[0] for c in SCANS.split(", ")])

    return rows.groupBy(*key, "stretch").applyInPandas(run, SCANS)
