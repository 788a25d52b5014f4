"""Registered queries and, where SQL expresses them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import curves, net
from .operators import behaviour, counts, daily_port, fragments, ingest, net_pairs, places, scans, ttl_shapes
from .plans.grammar import capture_filter
from .sources import synthetic as syn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

P, FR, GEO = (syn.duck(x) for x in (syn.PACKETS, syn.FRAGMENTS, syn.PLACES))
SEC = "(ts_us // 1000000)"


def add(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None, source: Callable = syn.packets, cte: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(source(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = f"WITH packets AS ({cte or P}) {sql}"


def _m(column: str, width: int) -> str:
    return column if width in (0, 32) else f"({column} & {0xFFFFFFFF & ~((1 << (32 - width)) - 1)})"


def _count_sql(fields: dict[str, str], interval: int, top: int | None = None, where: str = "true", share: bool = False) -> str:
    """The count query in SQL: intervals from the first packet, ranks by n and then the fields."""
    names = ", ".join(fields)
    keys = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in fields.items())
    extra = ", n / sum(n) OVER (PARTITION BY start) AS share" if share else ""
    rank = f" QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC, {names}) <= {top}" if top else ""
    return f""", kept AS (SELECT * FROM packets WHERE {where}), t0 AS (SELECT min(ts_us) // 1000000 AS s FROM kept),
        rows AS (SELECT s + ({SEC} - s) // {interval} * {interval} AS start, {keys} FROM kept, t0),
        c AS (SELECT start, {names}, count(*) AS n FROM rows GROUP BY ALL) SELECT start, {names}, n{extra} FROM c{rank}"""


DAY = 86400
PA = {"proto": "proto", "dport": "dport"}
add("count_pa", lambda p: counts.count_query(p, "PA", DAY, top=5), _count_sql(PA, DAY, 5))
add("count_s24", lambda p: counts.count_query(p, "S24", DAY, top=20), _count_sql({"saddr": _m("saddr", 24)}, DAY, 20))
add("count_d24", lambda p: counts.count_query(p, "D24", DAY), _count_sql({"daddr": _m("daddr", 24)}, DAY))
add("count_s", lambda p: counts.count_query(p, "S", DAY, top=50), _count_sql({"saddr": "saddr"}, DAY, 50))
add("count_d", lambda p: counts.count_query(p, "D", DAY, top=50), _count_sql({"daddr": "daddr"}, DAY, 50))
add("count_len", lambda p: counts.count_query(p, "L", DAY, top=10), _count_sql({"len": "len"}, DAY, 10))
add("count_s24_a", lambda p: counts.count_query(p, "S24A", DAY, top=30), _count_sql({"saddr": _m("saddr", 24), "dport": "dport"}, DAY, 30))
add("count_topn", lambda p: counts.count_query(p, "SA", 3600, top=3), _count_sql({"saddr": "saddr", "dport": "dport"}, 3600, 3))
add("count_normalized", lambda p: counts.count_query(p, "PA", DAY, normalized=True), _count_sql(PA, DAY, share=True))
add(
    "count_multi", lambda p: counts.count_queries(p, ["PA", "S24", "S", "D"], DAY, top=256),
    f""", t0 AS (SELECT min(ts_us) // 1000000 AS s FROM packets), rows AS (SELECT *, s + ({SEC} - s) // {DAY} * {DAY} AS start FROM packets, t0),
    q AS (SELECT 'PA' AS query, start, concat_ws(',', proto, dport) AS key FROM rows UNION ALL SELECT 'S24', start, CAST({_m('saddr', 24)} AS VARCHAR) FROM rows
          UNION ALL SELECT 'S', start, CAST(saddr AS VARCHAR) FROM rows UNION ALL SELECT 'D', start, CAST(daddr AS VARCHAR) FROM rows),
    c AS (SELECT query, start, key, count(*) AS n FROM q GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, start ORDER BY n DESC, key) <= 256""",
)
TOTAL = """, kept AS (SELECT * FROM packets WHERE {where}), t0 AS (SELECT min(ts_us) // 1000000 AS s FROM kept),
    c AS (SELECT s + (ts_us // 1000000 - s) // {i} * {i} AS start, count(*) AS n FROM kept, t0 GROUP BY ALL),
    e AS (SELECT unnest(range((SELECT min(start) FROM c), (SELECT max(start) FROM c) + 1, {i})) AS start)
    SELECT start, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (start)"""
add("count_total_gapfill", lambda p: counts.totals(p, 600), TOTAL.format(i=600, where="true"))
add("count_total_filtered", lambda p: counts.totals(p, 600, where="A=49160"), TOTAL.format(i=600, where="dport = 49160"))
add("filter_s8_p6", lambda p: counts.count_query(p, "PA", DAY, where="S8=158.0.0.0/P=6"), _count_sql(PA, DAY, where=f"{_m('saddr', 8)} = 2650800128 AND proto = 6"))
add("filter_ports", lambda p: p.where(capture_filter("udp and dst port 53 or not (tcp or icmp) and src net 128.0.0.0/1")).groupBy("proto", "dport").agg(F.count("*").alias("n")),
    "SELECT proto, dport, count(*) AS n FROM packets WHERE (proto = 17 AND dport = 53 OR NOT proto IN (1, 6)) AND saddr >= 2147483648 GROUP BY ALL")
add("filter_high_ports", lambda p: p.where("proto = 17 and dport > 49152").select("pindx", "saddr", "dport"), "SELECT pindx, saddr, dport FROM packets WHERE proto = 17 AND dport > 49152")
add("exclude_sources", lambda p: p.where(~F.col("saddr").isin(2654435761, 1013904226)).groupBy("proto").agg(F.count("*").alias("n")),
    "SELECT proto, count(*) AS n FROM packets WHERE saddr NOT IN (2654435761, 1013904226) GROUP BY ALL")
add("align_first", lambda p: counts.count_query(p, "P", DAY, align=60),
    _count_sql({"proto": "proto"}, DAY, where=f"ts_us >= (SELECT min(ts_us) FROM packets WHERE {SEC} % 60 = 0)"))
add("align_clock", lambda p: counts.count_query(p, "P", DAY, clock=True), f"SELECT {SEC} - {SEC} % {DAY} AS start, CAST(proto AS BIGINT) AS proto, count(*) AS n FROM packets GROUP BY ALL")
add("masks_and_text", lambda p: p.select("pindx", net.ip_text(F.col("saddr")).alias("ip"), net.slash24(net.ip_text(F.col("saddr"))).alias("net24"), net.network_offset(F.col("daddr"), 24).alias("host"), net.network_id(F.col("saddr"), 8).alias("srcnet"), net.protocol_name(F.col("proto")).alias("protocol")),
    """SELECT pindx, concat_ws('.', saddr >> 24, (saddr >> 16) & 255, (saddr >> 8) & 255, saddr & 255) AS ip, concat_ws('.', saddr >> 24, (saddr >> 16) & 255, (saddr >> 8) & 255) AS net24,
    daddr & 255 AS host, saddr >> 24 AS srcnet, CASE proto WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' END AS protocol FROM packets""")  # fmt: skip

NETS, SCANNERS = ["10.1.0.0/22  # near", "10.1.8.0/24", "# none", "2001:db8::/32"], ["158.0.0.0/7", "60.0.0.0/6"]
LONG_LIST = [f"{k}.{128 * (k * 37 // 7 % 2)}.0.0/9" for k in range(1, 224)]


def _in(column: str, networks: list[str]) -> str:
    return "(" + " OR ".join(f"{column} BETWEEN {a} AND {b}" for a, b in net.ranges(networks)) + ")"


add("cidr_semi", lambda p: net.member(p, "daddr", NETS).select("pindx"), f"SELECT pindx FROM packets WHERE {_in('daddr', NETS)}")
add("cidr_anti", lambda p: net.member(p, "saddr", SCANNERS, keep=False).select("pindx"), f"SELECT pindx FROM packets WHERE NOT {_in('saddr', SCANNERS)}")
add("cidr_semi_long", lambda p: net.member(p, "saddr", LONG_LIST).select("pindx"), f"SELECT pindx FROM packets WHERE {_in('saddr', LONG_LIST)}")
add("cidr_anti_long", lambda p: net.member(p, "saddr", LONG_LIST, keep=False).select("pindx"), f"SELECT pindx FROM packets WHERE NOT {_in('saddr', LONG_LIST)}")
add("allowed_minus_omitted", lambda p: ingest.valid_subnets(p, NETS, SCANNERS).select("pindx"), f"SELECT pindx FROM packets WHERE {_in('daddr', NETS)} AND NOT {_in('saddr', SCANNERS)}")
_part = lambda where: f"SELECT *, '{where[0]}' AS subset FROM packets WHERE {where[1]}"
add("ack_nack_trend", lambda p: ingest.scanner_trend(p, SCANNERS, ("PA", "S24"), DAY, 16),
    f""", known AS (SELECT * FROM packets WHERE {_in('saddr', SCANNERS)}), rest AS (SELECT * FROM packets WHERE NOT {_in('saddr', SCANNERS)}),
    u AS (SELECT 'all' AS subset, * FROM packets UNION ALL SELECT 'ack', * FROM known UNION ALL SELECT 'nack', * FROM rest),
    r AS (SELECT *, min(ts_us) OVER (PARTITION BY subset) // 1000000 AS s FROM u), b AS (SELECT *, s + ({SEC} - s) // {DAY} * {DAY} AS start FROM r),
    q AS (SELECT subset, 'PA' AS query, start, concat_ws(',', proto, dport) AS key FROM b UNION ALL SELECT subset, 'S24', start, CAST({_m('saddr', 24)} AS VARCHAR) FROM b),
    c AS (SELECT subset, query, start, key, count(*) AS n FROM q GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY subset, query, start ORDER BY n DESC, key) <= 16""")  # fmt: skip
HOUR = "ts_us // 3600000000 * 3600"
add("hour_rebin", ingest.hour_counts, f"SELECT {HOUR} AS hour, count(*) AS n FROM packets GROUP BY ALL")
add("hour_gapfill", lambda p: ingest.fill_hours(ingest.hour_counts(p.where("dport = 49160"))),
    f""", c AS (SELECT {HOUR} AS hour, count(*) AS n FROM packets WHERE dport = 49160 GROUP BY ALL), e AS (SELECT unnest(range((SELECT min(hour) FROM c), (SELECT max(hour) FROM c) + 1, 3600)) AS hour)
    SELECT hour, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (hour)""")  # fmt: skip
add("hour_index", ingest.hour_index, f"SELECT hour, CAST(row_number() OVER (ORDER BY hour) - 1 AS INT) AS place FROM (SELECT DISTINCT {HOUR} AS hour FROM packets)")
add("hour_names", lambda p: p.select("pindx", ingest.local_hour_name(F.expr("ts_us div 1000000"), "America/Los_Angeles").alias("name")),
    "SELECT pindx, strftime(make_timestamp(ts_us - 28800000000), '%Y-%m-%d-%H') AS name FROM packets")  # January: no summer time
add("missing_set", lambda p: ingest.missing(p, p.where("dport = 49160"), "saddr"), "SELECT DISTINCT saddr FROM packets WHERE saddr NOT IN (SELECT saddr FROM packets WHERE dport = 49160)")
add("dst_subnets", ingest.destination_subnets, " UNION ALL ".join(f"SELECT DISTINCT {w} AS width, {_m('daddr', w)} AS net FROM packets" for w in (24, 20, 16)))
SPANS = [(1704067200, 1704153600, "a"), (1704110400, 1704196800, "b"), (1704500000, 1704600000, "c")]
add("time_spans_join", lambda p: ingest.by_spans(p, SPANS).select("span", "pindx"),
    " UNION ALL ".join(f"SELECT '{n}' AS span, pindx FROM packets WHERE ts_us >= {a}000000 AND ts_us < {b}000000" for a, b, n in SPANS))

add("top_ports_by_sources", daily_port.ports_by_sources,
    f"SELECT dport, count(DISTINCT {_m('saddr', 24)}) AS nsrcs, count(*) AS npkts, round(count(*) / count(DISTINCT {_m('saddr', 24)}), 6) AS ratio FROM packets WHERE proto = 17 GROUP BY dport ORDER BY nsrcs DESC, npkts DESC, dport LIMIT 10")
DAILY = f""", d AS (SELECT ts_us // 86400000000 AS day, dport, count(DISTINCT {_m('saddr', 24)}) AS nsrcs, count(*) AS npkts FROM packets WHERE proto = 17 GROUP BY ALL),
    h AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day ORDER BY nsrcs DESC, npkts DESC, dport) <= 10),
    w AS (SELECT * FROM h WHERE dport > 49152 QUALIFY row_number() OVER (PARTITION BY day ORDER BY npkts / nsrcs, dport) = 1)"""
add("port_of_day", lambda p: daily_port.port_of_day(p, least_hours=1), DAILY + " SELECT day, dport, nsrcs, npkts FROM w")
HOURS = [*range(6), *range(10, 16)]
add("port_of_day_hours", lambda p: daily_port.port_of_day(p, least_hours=12, hours=HOURS),
    f""", e AS (SELECT ts_us // 86400000000 AS day FROM packets GROUP BY day HAVING count(DISTINCT ts_us // 3600000000) >= 12),
    d AS (SELECT ts_us // 86400000000 AS day, dport, count(DISTINCT {_m('saddr', 24)}) AS nsrcs, count(*) AS npkts FROM packets WHERE proto = 17 AND ts_us // 3600000000 % 24 IN ({', '.join(map(str, HOURS))}) GROUP BY ALL),
    h AS (SELECT * FROM d JOIN e USING (day) QUALIFY row_number() OVER (PARTITION BY day ORDER BY nsrcs DESC, npkts DESC, dport) <= 10)
    SELECT day, dport, nsrcs, npkts FROM h WHERE dport > 49152 QUALIFY row_number() OVER (PARTITION BY day ORDER BY npkts / nsrcs, dport) = 1""")  # fmt: skip
add("port_of_day_flow", daily_port.port_of_day_flows,
    """, d AS (SELECT ts_us // 86400000000 AS day, dport, count(DISTINCT saddr >> 8) AS nsrcs FROM packets WHERE proto = 17 AND dport >= 49152 GROUP BY ALL)
    SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day ORDER BY nsrcs DESC, dport) = 1""")  # fmt: skip
add("daily_port_lookup", lambda p: daily_port.packets_of_daily_port(p, daily_port.port_of_day(p, least_hours=1)).select("day", "dport", "pindx"),
    DAILY + " SELECT day, dport, pindx FROM w JOIN (SELECT *, ts_us // 86400000000 AS day FROM packets) USING (day, dport)")
add("count_sources_subnet", lambda p: daily_port.count_sources(p, "10.1.2.0/24"), f"SELECT count(DISTINCT saddr) AS nsrcs, count(*) AS npkts FROM packets WHERE {_in('daddr', ['10.1.2.0/24'])}")
add("src_per_hour", daily_port.sources_per_hour, f"SELECT {HOUR} AS hour, saddr, count(*) AS n FROM packets GROUP BY ALL")
_labelled = lambda p, c: p.groupBy(F.col(c).cast("string").alias("label")).agg(F.count("*").alias("n"))
add("merge_counts", lambda p: daily_port.merge_counts(_labelled(p, "dport"), _labelled(p, "proto")),
    "SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(dport AS VARCHAR) AS label, count(*) AS n FROM packets GROUP BY ALL UNION ALL SELECT CAST(proto AS VARCHAR), count(*) FROM packets GROUP BY ALL) GROUP BY label")
add("cumulative_sources", daily_port.cumulative_sources,
    f""", f AS (SELECT saddr, min({HOUR}) AS hour FROM packets GROUP BY saddr), n AS (SELECT hour, count(*) AS k FROM f GROUP BY hour), h AS (SELECT DISTINCT {HOUR} AS hour FROM packets)
    SELECT hour, coalesce(k, 0) AS new, CAST(sum(coalesce(k, 0)) OVER (ORDER BY hour) AS BIGINT) AS seen FROM h LEFT JOIN n USING (hour)""")  # fmt: skip
add("cumulative_counts", daily_port.cumulative_counts,
    f", c AS (SELECT {HOUR} AS hour, saddr, count(*) AS n FROM packets GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY saddr ORDER BY hour) AS BIGINT) AS total FROM c")

PAIRS = ["10.1.0.0/22", "10.1.2.0/23", "10.1.8.0/24"]
PAIR_SQL = ", pairs AS (SELECT saddr >> 24 AS srcnet, dst, count(*) AS npkts, count(DISTINCT saddr) AS nsrcs FROM (" + " UNION ALL ".join(f"SELECT saddr, CAST({k} AS INT) AS dst FROM packets WHERE {_in('daddr', [n])}" for k, n in enumerate(PAIRS)) + ") GROUP BY ALL)"
add("bubble_counts", lambda p: net_pairs.pair_counts(p, PAIRS), PAIR_SQL + " SELECT * FROM pairs")
add("bubble_nth", lambda p: net_pairs.nth_value(net_pairs.pair_counts(p, PAIRS), 95.0),
    PAIR_SQL + """, i AS (SELECT least(floor(count(*) * 95 / 100), count(*) - 1)::INT AS i FROM pairs)
    SELECT (SELECT list_sort(list(npkts)) FROM pairs)[i + 1] AS npkts, (SELECT list_sort(list(nsrcs)) FROM pairs)[i + 1] AS nsrcs FROM i""")  # fmt: skip
_xy = lambda f: lambda p: (lambda x, y: p.select("pindx", x.cast("long").alias("x"), y.cast("long").alias("y")))(*f(F.col("daddr").bitwiseAND(F.lit(0xFFFF))))
add("morton_xy", _xy(lambda c: curves.morton(c, 8)),
    "SELECT pindx, " + ", ".join("CAST(" + " | ".join(f"(((daddr >> {2 * k + s}) & 1) << {k})" for k in range(8)) + f" AS BIGINT) AS {n}" for s, n in ((0, "x"), (1, "y"))) + " FROM packets")
add("row_major_xy", _xy(lambda c: curves.row_major(c, 256)), "SELECT pindx, (daddr & 65535) % 256 AS x, (daddr & 65535) // 256 AS y FROM packets")
def _hilbert_sql() -> str:
    """The curve's conditional turns, a step a digit."""
    steps = ["h0 AS (SELECT pindx, daddr & 65535 AS d, 0::BIGINT AS x, 0::BIGINT AS y FROM packets)"]
    for k in range(8):
        rx, ry = f"((d >> {2 * k + 1}) & 1)", f"(xor(d >> {2 * k}, d >> {2 * k + 1}) & 1)"
        turned = f"CASE WHEN {ry} = 0 THEN CASE WHEN {rx} = 1 THEN {(1 << k) - 1} - {{0}} ELSE {{0}} END ELSE {{1}} END + {{2}} * {1 << k}"
        steps.append(f"h{k + 1} AS (SELECT pindx, d, {turned.format('y', 'x', rx)} AS x, {turned.format('x', 'y', ry)} AS y FROM h{k})")
    return ", " + ", ".join(steps) + " SELECT pindx, x, y FROM h8"


add("hilbert_xy", _xy(lambda c: curves.hilbert(c, 8)), _hilbert_sql())
add("arc_geometry", lambda p: (lambda c: c.join(F.broadcast(c.agg(F.max("npkts").alias("largest")))).select("srcnet", "dst", *(x.alias(n) for x, n in zip(curves.arc(F.col("npkts"), F.col("largest"), F.col("dst"), 3), ("radius", "angle"), strict=True))))(net_pairs.pair_counts(p, PAIRS)),
    PAIR_SQL + " SELECT srcnet, dst, 2 * npkts / (SELECT max(npkts) FROM pairs) AS radius, dst * 360.0::DOUBLE / 3 AS angle FROM pairs")
add("subnet_compare_band", lambda p: net_pairs.rank_band(p, 1, 8),
    f""", t AS (SELECT dport, count(*) AS total FROM packets GROUP BY dport ORDER BY total DESC, dport LIMIT 8), k AS (SELECT dport, CAST(row_number() OVER (ORDER BY total DESC, dport) AS INT) AS place FROM t)
    SELECT dport, place, {_m('daddr', 24)} AS net, count(*) AS n FROM packets JOIN k USING (dport) GROUP BY ALL""")  # fmt: skip
add("subnet_totals", net_pairs.subnet_totals, f"SELECT {_m('daddr', 24)} AS net, count(*) AS n FROM packets GROUP BY ALL")

SET = "saddr, daddr, proto, ipid"
add("frag_audit", fragments.audit,
    f""", l AS (SELECT *, lag(off) OVER w AS po, lag(plen) OVER w AS pl, lag(payload) OVER w AS pp FROM packets WINDOW w AS (PARTITION BY {SET} ORDER BY off, seq))
    SELECT {SET}, count(*) AS n_frags, count_if(off = 0)::BIGINT AS n_first, count_if(mf = 0)::BIGINT AS n_last, coalesce(count_if(off < po + pl), 0)::BIGINT AS n_overlap, coalesce(count_if(off > po + pl), 0)::BIGINT AS n_missing,
    coalesce(count_if(off < po + pl AND off = po AND payload <> pp), 0)::BIGINT AS n_diff FROM l GROUP BY ALL""", syn.fragments, FR)  # fmt: skip
add("frag_hourly", lambda f: ingest.fill_hours(ingest.hour_counts(f)),
    f""", c AS (SELECT {HOUR} AS hour, count(*) AS n FROM packets GROUP BY ALL), e AS (SELECT unnest(range((SELECT min(hour) FROM c), (SELECT max(hour) FROM c) + 1, 3600)) AS hour)
    SELECT hour, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (hour)""", syn.fragments, FR)  # fmt: skip
add("busiest_src", lambda f: fragments.busiest(f, "saddr"), "SELECT saddr, count(*) AS n FROM packets GROUP BY saddr ORDER BY n DESC, saddr LIMIT 10", syn.fragments, FR)
add("busiest_dst", lambda f: fragments.busiest(f, "daddr"), "SELECT daddr, count(*) AS n FROM packets GROUP BY daddr ORDER BY n DESC, daddr LIMIT 10", syn.fragments, FR)

YEAR = "year(make_timestamp(ts_us))"
add("year_stats", places.year_stats,
    f"SELECT {YEAR}::INT AS year, count(*) AS n, count(DISTINCT saddr) AS n_saddr, count(DISTINCT daddr) AS n_daddr, count(DISTINCT dport) AS n_dport, round(n_saddr / 12, 6) AS m_saddr, round(n_daddr / 12, 6) AS m_daddr, round(n_dport / 12, 6) AS m_dport FROM packets GROUP BY year(make_timestamp(ts_us))")


def geo(name: str, query: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(syn.packets(spark, sf_dir), syn.places(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH packets AS ({P}), places AS ({GEO}), located AS (SELECT * FROM packets LEFT JOIN places USING (saddr)) {sql}"


_by = lambda p, g, *keys: places.distinct_sources(places.with_places(p, g).withColumn("year", places.year()), keys)
COUNTRY = f", c AS (SELECT {YEAR}::INT AS year, country, count(DISTINCT saddr) AS nsrcs FROM located WHERE country IS NOT NULL GROUP BY ALL)"
CITY = f", c AS (SELECT {YEAR}::INT AS year, country, city, count(DISTINCT saddr) AS nsrcs FROM located WHERE country IS NOT NULL GROUP BY ALL)"
geo("geo_join", lambda p, g: places.with_places(p, g).select("pindx", "country", "city"), "SELECT pindx, country, city FROM located")
geo("sources_by_country", lambda p, g: _by(p, g, "year", "country"), COUNTRY + " SELECT * FROM c")
geo("sources_by_city", lambda p, g: _by(p, g, "year", "country", "city"), CITY + " SELECT * FROM c")
geo("pct_by_country", lambda p, g: places.percent_of(_by(p, g, "year", "country"), "nsrcs", ["year"]), COUNTRY + " SELECT *, round(nsrcs * 100.0::DOUBLE / sum(nsrcs) OVER (PARTITION BY year), 6) AS pct FROM c")
geo("top_countries", lambda p, g: places.largest(_by(p, g, "year", "country"), "nsrcs", ["year"], ["country"], 10),
    COUNTRY + " SELECT *, row_number() OVER (PARTITION BY year ORDER BY nsrcs DESC, country)::INT AS place FROM c QUALIFY place <= 10")
geo("top_cities", lambda p, g: places.largest(_by(p, g, "year", "country", "city"), "nsrcs", ["year"], ["country", "city"], 15),
    CITY + " SELECT *, row_number() OVER (PARTITION BY year ORDER BY nsrcs DESC, country, city)::INT AS place FROM c QUALIFY place <= 15")
geo("cities_per_country", places.cities_per_country, "SELECT country, count(DISTINCT city) AS n FROM located WHERE country IS NOT NULL GROUP BY country")
geo("pivot_year_net", lambda p, g: places.pivot_counts(places.with_places(p, g, "inner"), [net.mask(F.col("daddr"), 22).alias("net")], "region", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]),
    f"SELECT {_m('daddr', 22)} AS net, " + ", ".join(f"count(*) FILTER (region = '{r}') AS {r.replace(' ', '_')}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM located WHERE region IS NOT NULL GROUP BY ALL")
SEGMENTS = [("auto", "Vehicle"), ("machine", "Plant"), ("house", "Camera")]
geo("sources_by_device", lambda p, g: places.sources_by_device(p, g.select("saddr", places.device_type(places.normalized_banner(F.col("city")), SEGMENTS, "Server").alias("device"))),
    f""", d AS (SELECT saddr, CASE WHEN contains(lower(city), 'house') THEN 'Camera' WHEN contains(lower(city), 'machine') THEN 'Plant' WHEN contains(lower(city), 'auto') THEN 'Vehicle' ELSE 'Server' END AS device FROM places)
    SELECT {YEAR}::INT AS year, device, count(DISTINCT saddr) AS nsrcs FROM packets JOIN d USING (saddr) GROUP BY ALL""")  # fmt: skip
geo("asn_other", lambda p, g: places.with_others(places.with_places(p, g, "inner").groupBy(F.col("asn").cast("string").alias("asn"), "saddr").agg(F.count("*").alias("k")), "asn", "k", 0.5),
    """, r AS (SELECT CAST(asn AS VARCHAR) AS asn, saddr, count(*) AS k FROM located WHERE asn IS NOT NULL GROUP BY ALL), s AS (SELECT asn, sum(k) AS n FROM r GROUP BY asn), o AS (SELECT CASE WHEN n < (SELECT count(*) FROM r) * 0.5 THEN 'Other' ELSE asn END AS asn, n FROM s)
    SELECT asn, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY asn""")  # fmt: skip
geo("missing_geo", lambda p, g: places.without_place(p, g.where("region <> 'ASIA'")), "SELECT DISTINCT saddr FROM packets WHERE saddr NOT IN (SELECT saddr FROM places WHERE region <> 'ASIA')")
geo("week_slots_local", lambda p, g: places.week_slots(p, 3, 5.5), "SELECT ((isodow(t) - 1) * 24 + hour(t)) // 3 AS slot, count(*) AS n FROM (SELECT make_timestamp(ts_us + 19800000000) AS t FROM packets) GROUP BY ALL")
add("weekslot_counts", places.week_slots, "SELECT ((isodow(t) - 1) * 24 + hour(t)) // 3 AS slot, count(*) AS n FROM (SELECT make_timestamp(ts_us) AS t FROM packets) GROUP BY ALL")
add("ttl_hist", lambda p: places.histogram(p, "ttl", 48, 55, 7), "SELECT (ttl - 48)::BIGINT + 1 AS bin, count(*) AS n FROM packets GROUP BY ALL")
add("keep_last_dim", lambda p: places.keep_last(p.select("saddr", "pindx", "dport"), "saddr", "pindx"), "SELECT saddr, pindx, dport FROM packets QUALIFY row_number() OVER (PARTITION BY saddr ORDER BY pindx DESC) = 1")

DEVICES = [("large", "Camera"), ("small", "Router"), ("promo", "Printer")]


def table(name: str, of: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{of}.parquet"))
    ORACLE_SQL[name] = sql


table("device_type", "part", lambda t: t.groupBy(places.device_type(places.normalized_banner(F.col("p_type")), DEVICES, "Server").alias("device")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN contains(lower(p_type), 'promo') THEN 'Printer' WHEN contains(lower(p_type), 'small') THEN 'Router' WHEN contains(lower(p_type), 'large') THEN 'Camera' ELSE 'Server' END AS device, count(*) AS n FROM part GROUP BY ALL")
table("responding", "part", lambda t: places.responding(t.where("p_size < 20").select(F.col("p_size").alias("port")), t.select(F.col("p_partkey").alias("ip"))),
    "SELECT p_size AS port, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(DISTINCT p_partkey) FROM part), 6) AS pct FROM part WHERE p_size < 20 GROUP BY p_size")
table("as_split", "customer", lambda t: (lambda org: t.select(places.as_number(org).alias("number"), places.as_name(org).alias("name")))(F.concat(F.lit("AS"), F.col("c_custkey").cast("string"), F.lit(" Net of "), F.col("c_name"))),
    "SELECT CAST(c_custkey AS VARCHAR) AS number, 'Net of ' || c_name AS name FROM customer")
table("word_counts", "part", lambda t: places.word_counts(t.select(F.lower("p_type").alias("b")), "b"), "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")

add("packet_gap", lambda p: behaviour.packet_gap(p).select("pindx", "gap_us"), "SELECT pindx, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY saddr ORDER BY ts_us, pindx), 0) AS gap_us FROM packets")
add("port_interest", lambda p: behaviour.port_interest(p, 100).select("pindx", F.round("interest", 6).alias("interest")),
    """, g AS (SELECT *, row_number() OVER (ORDER BY ts_us, pindx) AS g FROM packets)
    SELECT pindx, coalesce(round(count(*) OVER (PARTITION BY dport ORDER BY g RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) / nullif(least(g - 1, 100), 0), 6), 0) AS interest FROM g""")  # fmt: skip
add("fingerprint_entropy", lambda p: p.where("proto = 17").select("pindx", behaviour.fingerprint().alias("fp"), F.round(behaviour.entropy(behaviour.fingerprint()), 6).alias("entropy")),
    """, f AS (SELECT pindx, printf('%04x%02x', dport, len % 256) AS fp FROM packets WHERE proto = 17), s AS (SELECT pindx, fp, unnest(string_split(fp, '')) AS c FROM f),
    n AS (SELECT pindx, fp, c, count(*) / any_value(length(fp)) AS p FROM s WHERE c <> '' GROUP BY pindx, fp, c) SELECT pindx, fp, round(-sum(p * ln(p)), 6) AS entropy FROM n GROUP BY ALL""")  # fmt: skip
add("pattern_having", lambda p: p.groupBy("ttl").agg(F.count("*").alias("n")).where("n > 9"), "SELECT ttl, count(*) AS n FROM packets GROUP BY ttl HAVING count(*) > 9")
add("horizontal_scans", lambda p: scans.horizontal_scans(p, 28, 120), source=syn.probes)
_lines = _count_sql(PA | {"saddr": _m("saddr", 24)}, DAY, 3)
_cut = _lines.rindex(" SELECT start")
add("result_lines", lambda p: counts.to_text(counts.count_query(p, "PAS24", DAY, top=3), "PAS24", tag=True),
    _lines[:_cut] + ", r AS (" + _lines[_cut:] + ") SELECT concat_ws(',', 'C', n, 'start_time', start, 'P', proto, 'A', dport, 'S24', concat_ws('.', saddr >> 24, (saddr >> 16) & 255, (saddr >> 8) & 255, saddr & 255) || '/24', 'PAS24') AS line FROM r")
add("total_lines", lambda p: counts.total_lines(p, "PA", 600), TOTAL.format(i=600, where="true").replace("SELECT start, coalesce(n, 0) AS n FROM e", "SELECT concat_ws(',', 'T', coalesce(n, 0), 'start_time', start, 'PA') AS line FROM e"))
add("total_lines_empty", lambda p: counts.total_lines(p.where("false"), "PA", 600), "SELECT 'T,0,start_time,0,PA' AS line WHERE NOT EXISTS (SELECT 1 FROM packets WHERE false)")
add("fingerprints", lambda p: p.select("pindx", behaviour.fingerprint().alias("fp")),
    "SELECT pindx, CASE proto WHEN 6 THEN printf('%04x%02x%02x', dport, 0, len % 256) WHEN 17 THEN printf('%04x%02x', dport, len % 256) ELSE printf('%02x%02x', dport % 256, len % 256) END AS fp FROM packets")
add("year_values", lambda p: places.year_values(p, "dport"), f"SELECT DISTINCT {YEAR}::INT AS year, dport FROM packets")
add("ttl_patterns", lambda p: ttl_shapes.describe(scans.horizontal_scans(p, 24, 120)), source=syn.sweeps)
_values = lambda p: behaviour.principal_values(behaviour.features(p.where("proto = 17")), 8, 16)
add("pc_values", _values)
add("hausdorff", lambda p: behaviour.distances(_values(p), "hausdorff", 2))
add("clusters", lambda p: behaviour.spectral_clusters(_values(p), 2, clusters=4))
