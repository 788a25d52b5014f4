"""Joins with geolocation and device tables, and yearly statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_places(packets: DataFrame, places: DataFrame, how: str = "left") -> DataFrame:
    """Packets with the place of their source; ``places`` has one row an address."""
    return packets.join(places, "saddr", how)


def without_place(packets: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct sources that the table lacks."""
    return packets.select("saddr").distinct().join(places.select("saddr"), "saddr", "left_anti")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def year() -> Column:
    return F.year(F.timestamp_micros("ts_us"))


def year_stats(packets: DataFrame, columns: Sequence[str] = ("saddr", "daddr", "dport"), months: int | None = 12) -> DataFrame:
    """Rows, distinct values and their monthly average for each year (without ``months``: over the months that have packets)."""
    rows = packets.withColumn("year", year())
    distinct = [F.count_distinct(c).alias(f"n_{c}") for c in columns]
    out = rows.groupBy("year").agg(F.count("*").alias("n"), F.count_distinct(F.month(F.timestamp_micros("ts_us"))).alias("_months"), *distinct)
    by = F.col("_months") if months is None else F.lit(months)
    return out.withColumns({f"m_{c}": F.round(F.col(f"n_{c}") / by, 6) for c in columns}).drop("_months")


def year_values(packets: DataFrame, column: str) -> DataFrame:
    """year and the distinct values of a column in it, a row each."""
    return packets.select(year().alias("year"), column).distinct()


def distinct_sources(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """nsrcs by keys; rows with a null key are dropped."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct("saddr").alias("nsrcs"))


def pivot_counts(rows: DataFrame, by: Sequence[Column], column: str, values: Sequence[str]) -> DataFrame:
    """Rows by some columns, with a count for each of the named values of another (0 for none; blanks in names become _)."""
    counts = [F.count_if(F.col(column) == v).alias(v.replace(" ", "_")) for v in values]
    return rows.groupBy(*by).agg(*counts)


def cities_per_country(packets: DataFrame, places: DataFrame) -> DataFrame:
    """country and its number of different cities among the packets' sources."""
    return with_places(packets, places, "inner").groupBy("country").agg(F.count_distinct("city").alias("n"))


def sources_by_device(packets: DataFrame, devices: DataFrame) -> DataFrame:
    """year, device, nsrcs; ``devices`` has saddr and device."""
    return distinct_sources(with_places(packets, devices, "inner").withColumn("year", year()), ["year", "device"])


def percent_of(rows: DataFrame, value: str, within: Sequence[str], name: str = "pct") -> DataFrame:
    return rows.withColumn(name, F.round(F.col(value) * 100.0 / F.sum(value).over(Window.partitionBy(*within)), 6))


def largest(rows: DataFrame, value: str, within: Sequence[str], ties: Sequence[str], top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(value), *ties))
    return rows.withColumn("place", place).where(F.col("place") <= top)


def week_slots(packets: DataFrame, hours: int = 3, offset_hours: float = 0.0) -> DataFrame:
    """slot (of the week, Monday first), n; an offset moves UTC to a place's time, fractions too."""
    local = F.timestamp_micros((F.col("ts_us") + int(offset_hours * 3_600_000_000)).cast("long"))
    slot = F.floor((F.weekday(local) * 24 + F.hour(local)) / hours)
    return packets.select(slot.cast("long").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))


def responding(devices: DataFrame, addresses: DataFrame, key: str = "port") -> DataFrame:
    """key, n, pct: devices by port (or type), and their percentage of all distinct addresses that were asked."""
    asked = addresses.agg(F.count_distinct("ip").alias("asked"))
    counts = devices.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(asked)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("asked"), 6).alias("pct"))  # one row


def as_number(org: Column) -> Column:
    """64500 of "AS64500 Name of it"."""
    return F.substring(F.substring_index(org, " ", 1), 3, 20)


def as_name(org: Column) -> Column:
    """"Name of it" of "AS64500 Name of it"; empty without a name."""
    return F.regexp_replace(org, r"^[^ ]* ?", "")


def with_others(rows: DataFrame, key: str, count: str, share: float = 0.05, of_packets: bool = False) -> DataFrame:
    """Counts by key, with those below ``share`` of the rows (or of the packets) as 'Other'."""
    sums = rows.groupBy(key).agg(F.sum(count).alias("n"))
    total = rows.agg((F.sum(count) if of_packets else F.count("*")).alias("total"))
    small = F.col("n") < F.col("total") * share
    return sums.join(F.broadcast(total)).withColumn(key, F.when(small, "Other").otherwise(F.col(key))).groupBy(key).agg(F.sum("n").alias("n"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int = 100) -> DataFrame:
    return rows.select(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def normalized_banner(column: Column) -> Column:
    """Lower case, signs to blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.translate(F.lower(column), ",;:/_-()[]\"'", " " * 12), r"\s+", " "))


def device_type(column: Column, types: Sequence[tuple[str, str]], default: str) -> Column:
    """The type of the last listed text that the banner contains."""
    out = F.lit(default)
    for text, kind in types:
        out = F.when(F.contains(column, F.lit(text)), kind).otherwise(out)
    return out


def word_counts(rows: DataFrame, column: str) -> DataFrame:
    words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def joined_lines(lines: DataFrame) -> DataFrame:
    """Records of (source, number, line): a line that doesn't begin with a digit continues the one before it."""
    starts = F.col("line").rlike("^[0-9]").cast("int")
    group = F.sum(starts).over(Window.partitionBy("source").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("record", group).groupBy("source", "record").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("parts"))
    return rows.where("record > 0").select("source", "record", F.concat_ws(" ", F.col("parts.line")).alias("text"))
