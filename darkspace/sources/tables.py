"""Text and binary tables of packets."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_number, within
from ..schema import PACKET_CSV
from .capture import expand, read_pcap

RECORD = np.dtype([("saddr", ">u4"), ("daddr", ">u4"), ("sport", ">u2"), ("dport", ">u2"), ("proto", "u1"), ("flags", "u1"), ("len", ">u2"), ("sec", ">i4"), ("usec", ">u4")])
RECORD_SCHEMA = "saddr long, daddr long, sport int, dport int, proto int, len int, ts_us long"


def epoch_micros(text):
    """Microseconds of ``seconds.fraction`` by its digits, not by a double."""
    seconds = F.substring_index(text, ".", 1).cast("long")
    fraction = F.substring(F.rpad(F.substring_index(text, ".", -1), 6, "0"), 1, 6).cast("long")
    return seconds * 1_000_000 + F.when(F.contains(text, F.lit(".")), fraction).otherwise(F.lit(0))


def _usable():
    """Whether a packet CSV row has what every packet needs; a time must have a fraction of a second."""
    out = F.coalesce(F.contains("ts_epoch", F.lit(".")), F.lit(False))
    for name in ("saddr", "daddr", "proto", "sport", "dport", "len"):
        out = out & F.col(name).isNotNull()
    return out


def read_packet_csv(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """Packet CSV (19 columns, or the 11 of flow logs). Rows without numbers or a fraction of a second fail if ``strict``, else are left out."""
    return _packets_of_csv(spark.read.csv(path, schema=PACKET_CSV, mode="PERMISSIVE"), strict)


def _packets_of_csv(rows: DataFrame, strict: bool) -> DataFrame:
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a packet: "), F.to_json(F.struct(*rows.columns)))).cast("long")
        rows = rows.withColumn("ts_us", F.when(_usable(), epoch_micros(F.col("ts_epoch"))).otherwise(bad)).where("ts_us is not null")
    else:
        rows = rows.where(_usable()).withColumn("ts_us", epoch_micros(F.col("ts_epoch")))
    return rows.drop("ts_epoch")


def rejected_rows(spark: SparkSession, path) -> DataFrame:
    """file, n: packet CSV rows that are left out unless ``strict``."""
    rows = spark.read.csv(path, schema=PACKET_CSV, mode="PERMISSIVE")
    return rows.where(~_usable()).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))


def _read_csv_lz4(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """Packet CSV in lz4 frames, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                lines = expand(raw).split(b"\n")
                for k in range(0, len(lines), 50_000):
                    kept = [x.decode("utf-8", "replace") for x in lines[k : k + 50_000] if x.strip()]
                    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return _packets_of_csv(lines.select(F.from_csv("line", PACKET_CSV, {"mode": "PERMISSIVE"}).alias("r")).select("r.*"), strict)


UDP_TEXT = "saddr string, daddr string, sport string, dport string, proto int, ts_epoch string, chksum string, plen int, payload string, ttl string, ipid string"


def read_udp_payloads(spark: SparkSession, path) -> DataFrame:
    """UDP payload lines (numbers in hexadecimal) of files called PREFIX-YYYY-MM-DD-HH-REST, with year, month, day and hour of the name."""
    name = F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "-")
    rows = spark.read.csv(path, schema=UDP_TEXT).withColumns({c: name[k].cast("int") for k, c in enumerate(("year", "month", "day", "hour"), 1)})
    rows = rows.withColumns({c: F.conv(c, 16, 10).cast("long") for c in ("saddr", "daddr", "sport", "dport", "chksum", "ttl", "ipid")})
    return rows.withColumn("payload", F.unhex("payload")).withColumn("date", F.make_date("year", "month", "day")).withColumn("ts_us", epoch_micros(F.col("ts_epoch"))).drop("ts_epoch")


def udp_payload_lines(packets: DataFrame) -> DataFrame:
    """Those lines, of UDP packets of a capture whose payload was captured whole."""
    whole = (F.col("proto") == 17) & (F.octet_length("payload") == F.col("len") - 4 * F.col("ip_ihl") - 8)
    hexed = lambda c, n: F.lower(F.lpad(F.hex(F.col(c).cast("long")), n, "0"))
    time = F.concat(F.expr("ts_us div 1000000"), F.lit("."), F.lpad(F.pmod("ts_us", F.lit(1_000_000)).cast("string"), 6, "0"))
    parts = [hexed("saddr", 8), hexed("daddr", 8), hexed("sport", 4), hexed("dport", 4), F.col("proto").cast("string"), time, hexed("p_chksum", 4), F.octet_length("payload").cast("string"), F.lower(F.hex("payload")), hexed("ttl", 2), hexed("ipid", 4)]
    return packets.where(whole).select(F.concat_ws(",", *parts).alias("line"))


def read_scan_records(spark: SparkSession, path) -> DataFrame:
    """Scans written as four lines (names and values, offsets, times, TTLs), as ``describe`` takes them."""
    rows = spark.read.text(path, lineSep="src ").where(F.trim("value") != "").select(F.split(F.concat(F.lit("src "), F.col("value")), "\n").alias("l"))
    words = F.split(F.trim(F.col("l")[0]), r"\s+")
    pairs = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int") - 1), lambda k: F.struct(F.element_at(words, 2 * k + 1), F.element_at(words, 2 * k + 2))))
    listed = lambda k, kind: F.split(F.regexp_extract(F.col("l")[k], r"\[(.*)\]", 1), ", ").cast(f"array<{kind}>")
    rows = rows.where(F.size("l") >= 4).select(pairs.alias("p"), listed(1, "long").alias("offs"), listed(2, "double").alias("times"), listed(3, "long").alias("ttls"))
    kinds = {"src": "long", "dst": "long", "proto": "int", "dport": "int", "start": "double", "elapsed": "double"}
    return rows.select(*(F.try_element_at("p", F.lit(n)).cast(k).alias(n) for n, k in kinds.items()), F.size("offs").alias("cnt"), F.size(F.array_distinct("offs")).alias("cov"), "offs", "times", "ttls")


def scan_record_lines(scans: DataFrame) -> DataFrame:
    """Scans as those four lines."""
    head = F.concat_ws(" ", *(x for n in ("src", "dst", "proto", "dport", "cov", "cnt", "start", "elapsed") for x in (F.lit(n), F.col(n).cast("string"))))
    listed = lambda name, c: F.concat(F.lit(f"{name} ["), F.concat_ws(", ", F.col(c).cast("array<string>")), F.lit("]"))
    return scans.select(F.concat_ws("\n", head, listed("offs", "offs"), listed("times", "times"), listed("ttls", "ttls")).alias("line"))


def read_conn_log(spark: SparkSession, path, monitored: Sequence[str], internal: Sequence[str] = (), keep: str = "single") -> DataFrame:
    """Flow log lines as packets: sources outside, destinations in the monitored networks.

    keep: 'single' (one packet there and none back), 'established' (four or
    more on a side) or 'all'. IPv6 and lines that don't begin with 1 or 2 go.
    """
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike("^[12]")).where(~F.contains(w[2], F.lit(":")) & ~F.contains(w[4], F.lit(":")))
    number = lambda k: F.expr(f"try_cast(split(trim(value), '\\\\s+')[{k}] as long)")
    rows = rows.select(
        ip_number(w[2]).alias("saddr"), ip_number(w[4]).alias("daddr"), F.when(w[6] == "tcp", 6).when(w[6] == "udp", 17).when(w[6] == "icmp", 1).otherwise(0).alias("proto"),
        w[3].cast("int").alias("sport"), w[5].cast("int").alias("dport"), number(17).cast("int").alias("len"), epoch_micros(w[0]).alias("ts_us"), number(16).alias("there"), number(18).alias("back"),
    )
    if keep == "single":
        rows = rows.where("there = 1 and back = 0")
    elif keep == "established":
        rows = rows.where("there >= 4 or back >= 4")
    rows = rows.where(within(F.col("daddr"), monitored))
    return (rows.where(~within(F.col("saddr"), internal)) if internal else rows).drop("there", "back")


def read_packed(spark: SparkSession, path) -> DataFrame:
    """Files of 24-byte big-endian records, plain or compressed; one task holds a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in map(expand, batch.column(0).to_pylist()):
                for start in range(0, len(raw) // RECORD.itemsize, 1 << 18):
                    x = np.frombuffer(raw, RECORD, min(1 << 18, len(raw) // RECORD.itemsize - start), start * RECORD.itemsize)
                    columns = [x["saddr"].astype(np.int64), x["daddr"].astype(np.int64), *(x[k].astype(np.int32) for k in ("sport", "dport", "proto", "len")), x["sec"].astype(np.int64) * 1_000_000 + x["usec"]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["saddr", "daddr", "sport", "dport", "proto", "len", "ts_us"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def packed_records(packets: DataFrame) -> DataFrame:
    """Packets as blobs of 24-byte records, a few to a partition, for a binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros(batch.num_rows, RECORD)
            for k, name in enumerate(("saddr", "daddr", "sport", "dport", "proto", "len")):
                x[name] = batch.column(k).to_numpy(zero_copy_only=False)
            x["sec"], x["usec"] = np.divmod(batch.column(6).to_numpy(zero_copy_only=False), 1_000_000)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["content"])

    return packets.selectExpr("saddr", "daddr", "sport", "dport", "proto", "len", "ts_us").mapInArrow(run, "content binary")


def write_packed(packets: DataFrame, folder: str) -> None:
    """A file of 24-byte records for each partition, in a folder that all executors share; a file appears under its name once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.fc5")
        own, n = f"{place}~{TaskContext.get().taskAttemptId()}", 0
        os.makedirs(folder, exist_ok=True)
        with open(own, "wb") as f:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    n += f.write(raw)
        os.replace(own, place)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["bytes"])

    packed_records(packets).mapInArrow(run, "bytes long").collect()  # a number a partition


def read_banners(spark: SparkSession, path) -> DataFrame:
    """ts, ip, port, banner of ``ts|ip:port|banner`` logs whose records may span lines (order within a file by byte offset of its text)."""
    from ..operators.places import joined_lines

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.posexplode(F.split("value", "\n")).alias("number", "line"))
    p = F.split("text", r"\|", 3)
    return joined_lines(whole).select(p[0].alias("ts"), F.substring_index(p[1], ":", 1).alias("ip"), F.substring_index(p[1], ":", -1).cast("int").alias("port"), p[2].alias("banner"))


#: File suffixes and the formats they stand for; a compression's suffix may follow.
SUFFIXES = {"csv": "csv", "pcap": "pcap", "fc5": "packed", "packed": "packed", "parquet": "parquet"}


def read_packets(spark: SparkSession, path: str | Sequence[str], format: str | None = None, **options) -> DataFrame:
    """Packets by format or by a path's suffix: csv, fc5 (24-byte records), pcap or parquet; the first three also as gz, bz2, xz or lz4.

    Several paths, of whatever formats, are one table, with null for columns
    that a format lacks. Order is by ts_us where an operator needs one.
    """
    if not isinstance(path, str):
        tables = [read_packets(spark, p, format, **options) for p in path]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    base = path.rstrip("*/")
    packed = next((s for s in ("gz", "bz2", "xz", "lz4") if base.endswith(f".{s}")), None)
    kind = format or SUFFIXES.get((base.removesuffix(f".{packed}") if packed else base).rpartition(".")[2])
    if kind == "csv" and packed == "xz":
        raise ValueError("csv in xz isn't supported: recompress as gz")
    if kind == "csv":
        return (_read_csv_lz4 if packed == "lz4" else read_packet_csv)(spark, path, **options)
    if kind == "packed":
        return read_packed(spark, path)
    if kind == "pcap":
        return read_pcap(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format of {path!r}")
