"""Grammar, crafted rows, captures, scans, shapes and streams."""

import gzip
import random
import struct
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkspace.functions import net
from darkspace.operators import behaviour, counts, fragments, ingest, places, scans, ttl_shapes
from darkspace.plans import grammar
from darkspace.sources import capture, tables
from darkspace.streaming import packets as streaming


def packets(spark, rows):
    """(second, saddr, daddr, proto, dport)"""
    data = [(k, s, d, p, 1000, a, 40, 0, 64, int(t * 1_000_000)) for k, (t, s, d, p, a) in enumerate(rows)]
    return spark.createDataFrame(data, "pindx long, saddr long, daddr long, proto int, sport int, dport int, len int, ipid int, ttl int, ts_us long")


def test_grammar_rejects(spark):
    for bad in ("", "Q", "S33", "S 24"):
        with pytest.raises(ValueError):
            grammar.parse_query(bad)
    for bad in ("L=4", "u=1", "S=12", "P=tcp", "S24"):
        with pytest.raises(ValueError):
            grammar.parse_filter(bad)
    for bad in ("host", "frobnicate", "(tcp", "tcp )"):
        with pytest.raises(ValueError):
            grammar.capture_filter(bad)
    assert grammar.parse_query("S24A") == [("S", 24), ("A", 0)]


def test_empty_interval_and_alignment(spark):
    p = packets(spark, [(t, 1, 2, 6, 23) for t in (0, 1, 20, 21)])
    assert [tuple(r) for r in counts.totals(p, 10).orderBy("start").collect()] == [(0, 2), (10, 0), (20, 2)]
    p = packets(spark, [(t, 1, 2, 6, 23) for t in (7, 10, 11)])
    assert counts.aligned(p, 10).count() == 2
    assert [r.start for r in counts.count_query(p, "P", 10, clock=True).orderBy("start").collect()] == [0, 10]
    assert counts.totals(packets(spark, []), 10).count() == 0


def test_masked_field_before_another_is_one_group(spark):
    a = net.ranges(["1.1.1.1"])[0][0]
    p = packets(spark, [(0, a, 2, 6, 23), (0, a, 2, 6, 80), (0, a + 1, 2, 6, 23)])
    got = {(r.dport, r.n) for r in counts.count_query(p, "S24A", 900).collect()}
    assert got == {(23, 2), (80, 1)}
    line = counts.to_text(counts.count_query(p, "PAS24", 900, top=1), "PAS24").first().line
    assert line == "C,2,start_time,0,P,6,A,23,S24,1.1.1.0/24"


def test_counts_without_limit_add_up(spark):
    rng = random.Random(1)
    p = packets(spark, [(rng.randrange(5000), rng.randrange(1 << 32), rng.randrange(1 << 32), rng.choice((1, 6, 17)), rng.randrange(9)) for _ in range(500)])
    total = counts.totals(p, 600).agg(F.sum("n")).first()[0]
    assert total == 500 == counts.count_query(p, "S8A", 600).agg(F.sum("n")).first()[0]
    narrow, wide = (counts.count_query(p, q, 10000).count() for q in ("S8", "S16"))
    assert narrow <= wide


def test_networks(spark):
    assert net.ranges(["10.0.0.0/8 # x", "", "# y", "10.1.0.0/16", "::1"]) == [(10 << 24, (11 << 24) - 1)]
    p = packets(spark, [(0, 1, 10 << 24, 6, 1), (0, 1, 11 << 24, 6, 1), (0, 1, None, 6, 1)])
    assert net.member(p, "daddr", ["10.0.0.0/8"]).count() == 1
    assert net.member(p, "daddr", ["10.0.0.0/8"], keep=False).count() == 1
    many = [f"{k}.0.0.0/17" for k in range(1, 200)]
    assert net.member(p, "daddr", many).count() == 2 and net.member(p, "daddr", many, keep=False).count() == 0
    texts = {r[0] for r in p.where("daddr is not null").select(net.ip_text(F.col("daddr"))).collect()}
    assert texts == {"10.0.0.0", "11.0.0.0"}


def test_missing_and_gap_fill(spark):
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert sorted(r.name for r in ingest.missing(names("abcde"), names("abc"), "name").collect()) == ["d", "e"]
    hours = spark.createDataFrame([(0, 4), (7200, 1)], "hour long, n long")
    assert [tuple(r) for r in ingest.fill_hours(hours).orderBy("hour").collect()] == [(0, 4), (3600, 0), (7200, 1)]


def test_fragment_audit(spark):
    rows = [(k, 1, 2, 17, 5, off, 8, 1, body) for k, (off, body) in enumerate([(0, "a"), (8, "b"), (8, "c"), (24, "d")])]
    f = spark.createDataFrame(rows, "seq long, saddr long, daddr long, proto int, ipid int, off int, plen int, mf int, payload string")
    r = fragments.audit(f).first()
    assert (r.n_frags, r.n_first, r.n_overlap, r.n_diff, r.n_missing) == (4, 1, 1, 1, 1)


def test_banners(spark, tmp_path):
    (tmp_path / "b.log").write_text("1|1.2.3.4:80|Hello, World\nmore of it\n2|1.2.3.5:22|SSH\n")
    got = sorted(tuple(r) for r in tables.read_banners(spark, str(tmp_path)).collect())
    assert [(g[1], g[2]) for g in got] == [("1.2.3.4", 80), ("1.2.3.5", 22)] and "more of it" in got[0][3]
    df = spark.createDataFrame([("a camera and router",), ("nothing",)], "b string")
    kinds = [r[0] for r in df.select(places.device_type(F.col("b"), [("camera", "Camera"), ("router", "Router")], "Server")).collect()]
    assert kinds == ["Router", "Server"]


def ipv4(proto, body, src=0x01020304, dst=0x0A010203, off=0):
    return struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(body), 7, off, 64, proto, 0, src, dst) + body


def capture_file(link, frames):
    out = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, link)
    for k, f in enumerate(frames):
        out += struct.pack("<IIII", 100 + k, 5, len(f), len(f)) + f
    return out


def test_captures(spark, tmp_path):
    tcp = struct.pack(">HHIIBBHHH", 1234, 23, 9, 8, 0x50, 2, 100, 0, 0)
    ether = lambda p, tags=0: bytes(12) + b"\x81\x00\x00\x01" * tags + b"\x08\x00" + p
    frames = [ether(ipv4(6, tcp)), ether(ipv4(17, struct.pack(">HHHH", 5, 53, 8, 0)), 2), ether(ipv4(1, b"\x08\x00\x00\x00")), ether(ipv4(17, b"rest", off=3)), bytes(12) + b"\x86\xdd" + bytes(40), ether(ipv4(6, b"shor"))]
    raw = capture_file(1, frames) + b"cut"
    (tmp_path / "a.pcap").write_bytes(raw)
    (tmp_path / "b.pcap.gz").write_bytes(gzip.compress(capture_file(101, [ipv4(132, struct.pack(">HHII", 7, 8, 0, 0))])))
    rows = sorted((r.proto, r.sport, r.dport, r.pindx) for r in capture.read_pcap(spark, str(tmp_path)).collect())
    assert rows == [(1, 8, 0, 3), (6, 1234, 23, 1), (17, 5, 53, 2), (132, 7, 8, 1)]
    assert len(list(capture.packets_of(raw, fragments=True))) == 4
    assert [p["sport"] for p in capture.packets_of(raw, words=True)][2] == 0x0800
    with pytest.raises(ValueError):
        list(capture.packets_of(bytes(24)))


def test_packed_round_trip_and_csv(spark, tmp_path):
    p = packets(spark, [(1.5, 3000000000, 5, 6, 23), (2, 1, 4294967295, 17, 65535)]).coalesce(1)
    (tmp_path / "x.packed").write_bytes(b"".join(r.content for r in tables.packed_records(p).collect()))
    back = sorted(tuple(r) for r in tables.read_packets(spark, str(tmp_path / "x.packed")).collect())
    assert back == sorted(tuple(r) for r in p.select("saddr", "daddr", "sport", "dport", "proto", "len", "ts_us").collect())
    (tmp_path / "p.csv").write_text("1,2,6,1000,23,-1,40,-1,-1,-1,1700000000.25\n1,2,17,1,53,-1,40,-1,-1,-1,17\n")
    assert [r.ts_us for r in tables.read_packets(spark, str(tmp_path / "p.csv")).collect()] == [1700000000250000]


def test_conn_log(spark, tmp_path):
    line = lambda ts, s, d, there, back: " ".join([ts, "uid", s, "1000", d, "23", "tcp", *["-"] * 9, str(there), "44", str(back)])
    (tmp_path / "conn.log").write_text("\n".join(["#fields", line("1700000000.5", "8.8.8.8", "10.1.0.5", 1, 0), line("1700000001.0", "8.8.8.9", "10.1.0.5", 9, 9), line("1700000002.0", "fe80::1", "10.1.0.5", 1, 0), line("1700000003.0", "8.8.8.8", "9.9.9.9", 1, 0)]))
    read = lambda **o: tables.read_conn_log(spark, str(tmp_path), ["10.1.0.0/16"], **o).count()
    assert (read(), read(keep="established"), read(keep="all"), read(internal=["8.8.8.8/32"])) == (1, 1, 2, 0)


def test_inversions():
    assert scans.exchange_inversions([2, 2, 1]) == 1 and scans.inversions([2, 2, 1]) == 2
    n = list(range(20))
    assert scans.exchange_inversions(n[::-1]) == 190 == scans.inversions(n[::-1]) and scans.inversions(n) == 0


def scan_model(rows, needed, most):
    """Packet by packet, per key."""
    out, held = 0, {}
    for t, key, off in rows:
        own = held.setdefault(key, [])
        own.append((t, off))
        if len({o for _, o in own}) < needed:
            continue
        while own[0][0] < t - most:
            own.pop(0)
        if len({o for _, o in own}) >= needed:
            out += 1
            held[key] = []
    return out


def test_scans_against_a_model(spark):
    rng = random.Random(5)
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice((0.1, 0.5, 9.0)) * rng.random()
        rows.append((t, rng.randrange(3), rng.randrange(8), 6, 23))
    got = scans.horizontal_scans(packets(spark, rows), 29, 60).collect()
    assert len(got) == scan_model([(int(t * 1e6), s, d) for t, s, d, *_ in rows], 8, 60_000_000) > 5
    assert all(r.cov == 8 and r.cnt == len(r.offs) for r in got)


def test_shapes():
    base = np.arange(64).reshape(8, 8) % 2 + (np.arange(8) // 4)[:, None] * 0
    same = np.block([[base, base], [base, base]]) + 50
    assert "S_AB" in ttl_shapes.patterns(same)[50]
    tall = np.tile(np.repeat([0, 1], 4)[:, None], (1, 8))
    flipped = np.block([[tall, tall[::-1]], [tall, tall]]) + 50
    found = ttl_shapes.patterns(flipped)[50]
    assert "MLR_AB" in found and "MUD_AB" not in found
    assert "MUD_AB" in ttl_shapes.patterns(flipped, corrected=True)[50]
    assert ttl_shapes.patterns(np.full((16, 16), 50)) == {}
    assert ttl_shapes.normalized([2, 2, 2, 6]) == [1, 1, 1, 5] and ttl_shapes.ranks([3, 3, 3, 10]) == [0, 0, 0, 1]


def test_ttl_patterns_follow_the_input(spark, tmp_path):
    from darkspace import catalog

    for n in (2, 5):
        events = spark.range(0, 256 * n + 100).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 1000 + 1).alias("user_id"))
        events.repartition(3).write.parquet(str(tmp_path / f"{n}" / "events.parquet"))
        got = sorted(catalog.QUERIES["ttl_patterns"](spark, str(tmp_path / f"{n}")).collect())
        assert [r.src for r in got] == [3000000000 + k for k in range(n)] and any(r.pattern for r in got)


def test_behaviour(spark):
    rows = spark.createDataFrame([("aabb", "abcc"), ("aaaa", "aaaa")], "a string, b string")
    got = [tuple(r) for r in rows.select(behaviour.entropy(F.col("a")), behaviour.divergence(F.col("a"), F.col("b")), behaviour.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx((np.log(2), np.log(2), 0.5 * 0.25 * 2 / (np.sqrt(0.5) * np.sqrt(0.375)))) and got[1] == pytest.approx((0, 0, 1))
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    d = np.abs(x - x.T)
    for labels in (behaviour.agglomerate(d, clusters=3), behaviour.mean_shift(x, bandwidth=1.0), behaviour.spectral(d, 3)):
        assert len(set(labels.tolist())) == 3 and labels[0] == labels[1] and labels[2] == labels[3]
    assert behaviour.silhouette(d, np.array([0, 0, 1, 1, 2])) > 0.7 and behaviour.davies_bouldin(x, np.array([0, 0, 1, 1, 2])) < 0.1
    assert behaviour.hausdorff(x, x + 1) == pytest.approx(1.0)


@pytest.mark.parametrize("kind", ["hausdorff", "spectral"])
def test_distances_send_a_series_once_for_each_large_block(spark, monkeypatch, kind):
    assert behaviour.blocks_for(6, 90_000, 90_000 * 170) == 5  # two groups a core; one for each 128 sources before
    assert behaviour.blocks_for(6, 100, 2000) == 1 and behaviour.blocks_for(1, 10**6, 10**9) == 239
    monkeypatch.setattr(behaviour, "SOURCES", 9)
    g = np.random.default_rng(4)
    series = {50 + s: g.random((int(g.integers(2, 5)), 10)) for s in range(70)}
    values = spark.createDataFrame([(s, k, *map(float, r)) for s, x in series.items() for k, r in enumerate(x)], [c.split()[0] for c in behaviour.COMPONENTS.split(", ")])
    for size in (32 << 20, 4000):  # several chunks of sources in a block, and blocks of a few
        monkeypatch.setattr(behaviour, "BLOCK", size)
        rows = behaviour.distances(values, kind, 2).collect()
        assert len(rows) == 70 * 69 // 2
        for a, b, d in rows:
            x, y = series[a], series[b]
            assert a < b and d == pytest.approx(behaviour.hausdorff(x, y) if kind == "hausdorff" else np.linalg.norm(behaviour.spectrum(x, 2) - behaviour.spectrum(y, 2)))


@pytest.mark.parametrize("kind", ["hausdorff", "spectral"])
def test_distances_of_all_sources_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(behaviour, "SOURCES", 150)
    g = np.random.default_rng(3)
    series = {1000 + s: g.random((int(g.integers(2, 7)) if s else 600, 10)) for s in range(520)}
    columns = [c.split()[0] for c in behaviour.COMPONENTS.split(", ")]
    values = spark.createDataFrame([(s, k, *map(float, r)) for s, x in series.items() for k, r in enumerate(x)] + [(1, 0, *[0.0] * 10)], columns)
    got = {(r.a, r.b): r.distance for r in behaviour.distances(values, kind, 2).collect()}
    assert set(got) == {(a, b) for a in series for b in series if a < b}
    for a, b in [(1000, 1001), (1000, 1519), *((int(a), int(b)) for a, b in np.sort(g.choice(520, (200, 2)), axis=1) + 1000 if a < b)]:
        k = min(map(len, series.values()))  # of all sources
        assert got[a, b] == pytest.approx(behaviour.hausdorff(series[a], series[b]) if kind == "hausdorff" else np.linalg.norm(behaviour.spectrum(series[a], k) - behaviour.spectrum(series[b], k)))
    labels = behaviour.clusters(behaviour.distances(values, kind, 2), clusters=4).collect()
    assert sorted(r.saddr for r in labels) == sorted(series)
    if kind == "hausdorff":
        few = behaviour.distances(values.where("saddr <= 1001"), kind, 2, rows=1).first().distance
        assert np.isclose(few, np.linalg.norm(series[1000][:, None] - series[1001][None], axis=2)).any()


def test_streams(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1000 + k * 0.2, 1, off, 6, 23) for k, off in enumerate(rng.sample(range(8), 8) * 3)]
    p = packets(spark, rows)
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("c", streaming.stream_counts(source, "PA", "1 minute"), "complete"), ("s", streaming.stream_scans(source, 29, 10), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [(r.proto, r.dport, r.n) for r in spark.table("c").collect()] == [(6, 23, 24)]
    assert spark.table("s").count() == scans.horizontal_scans(p, 29, 10).count() == 3


def test_filter_words_bind_from_left_to_right(spark):
    p = packets(spark, [(0, 1, 2, 17, 9), (0, 1, 2, 6, 53), (0, 1, 2, 17, 53), (0, 1, 2, 1, 0)])
    got = lambda text: sorted((r.proto, r.dport) for r in p.where(grammar.capture_filter(text)).collect())
    assert got("udp or tcp and port 53") == [(6, 53), (17, 53)]
    assert got("port 53 and tcp or udp") == [(6, 53), (17, 9), (17, 53)]
    assert got("udp or (tcp and port 53)") == [(6, 53), (17, 9), (17, 53)]
    assert got("not udp and not tcp") == [(1, 0)]


def test_all_labels_by_brute_force():
    """Every pair, test and negation, quadrant against quadrant, cell by cell."""
    rng = np.random.default_rng(0)
    side = {"A": (0, 0), "B": (0, 8), "C": (8, 0), "D": (8, 8)}
    moves = {"S": lambda i, j: (i, j), "MUD": lambda i, j: (i, 7 - j), "MLR": lambda i, j: (7 - i, j), "R90": lambda i, j: (j, 7 - i), "R180": lambda i, j: (7 - i, 7 - j), "R270": lambda i, j: (7 - j, i)}
    order = {"DB": "BD", "DnB": "BnD"}
    seen = set()
    for label in [f"{t}_{p}" for t in ttl_shapes.TESTS for p in ttl_shapes.PAIRS]:
        test, pair = label.split("_")
        pair = order.get(pair, pair)
        m = rng.integers(0, 2, (16, 16))
        (a, b), (c, d) = side[pair[0]], side[pair[-1]]
        for i in range(8):
            for j in range(8):
                x, y = moves[test](i, j)
                m[c + i, d + j] = m[a + x, b + y] ^ ("n" in pair)
        found = ttl_shapes.patterns(m + 60)[60]
        expected = []
        for other in [f"{t}_{p}" for t in ttl_shapes.TESTS for p in ttl_shapes.PAIRS]:
            t, p = other.split("_")
            p = order.get(p, p)
            (a, b), (c, d) = side[p[0]], side[p[-1]]
            gaps = sum(m[c + i, d + j] != (m[a + moves[t](i, j)[0], b + moves[t](i, j)[1]] ^ ("n" in p)) for i in range(8) for j in range(8))
            expected += [other] if gaps <= 4 else []
        assert found == sorted(expected) and label in found
        seen |= set(found)
    assert len(seen) == 72


def test_hashes_take_the_first_probe_and_the_least_ttl():
    import hashlib

    offs, ttls = [*range(255), 7], [60 + k % 2 for k in range(255)] + [99]
    _, dhash, nhash = ttl_shapes.shape_of(offs, ttls)
    values = [60 + k % 2 for k in range(255)] + [-1]
    assert nhash == hashlib.sha1(", ".join(str(v - 59) for v in values).encode()).hexdigest()
    assert dhash == hashlib.sha1(", ".join(str({60: 0, 61: 1, -1: 2}[v]) for v in values).encode()).hexdigest()
    assert ttl_shapes.grid(offs, ttls).ravel()[7] == 99 and ttl_shapes.grid(offs, ttls).ravel()[255] == 1


def test_labels_together(spark):
    labels = spark.createDataFrame([("d", "n", 60, "S_AB"), ("d", "n", 60, "S_AC"), ("e", "n", 60, "S_AB"), ("e", "n", 61, "R90_AB")], "dhash string, nhash string, ttl int, label string")
    got = lambda *a: sorted(tuple(r) for r in ttl_shapes.with_labels(labels, *a).collect())
    assert got(["S_AB"]) == [("d", "n", 60), ("e", "n", 60)] and got(["S_AB"], ["S_AC"]) == [("e", "n", 60)] and got(["S_AB", "S_AC"]) == [("d", "n", 60)]


def test_fragments_of_a_capture(spark, tmp_path):
    frames = [ipv4(17, b"\x00\x05\x00\x35" + b"abcd", off=0x2000), ipv4(17, b"efghijkl", off=0x2001), ipv4(17, b"EFGHIJKL", off=0x2001), ipv4(17, b"tail", off=4), ipv4(17, struct.pack(">HHHH", 5, 53, 8, 0))]
    (tmp_path / "f.pcap").write_bytes(capture_file(101, frames))
    p = tables.read_packets(spark, str(tmp_path / "f.pcap"), fragments=True)
    r = fragments.audit(fragments.only_fragments(p)).first()
    assert (r.n_frags, r.n_first, r.n_last, r.n_overlap, r.n_missing, r.n_diff) == (4, 1, 1, 1, 1, 1)
    lines = [x.line for x in fragments.fragment_lines(p).collect()]
    assert lines[:2] == ["16909060,167838211,5,53,17,100.000005,8,7,1,0,0005003561626364", "16909060,167838211,0,0,17,101.000005,8,7,1,8,65666768696a6b6c"] and len(lines) == 4
    assert fragments.fragment_lines(p, only=False, payload=False).count() == 5
    short = spark.createDataFrame([(1, 10, 5, 0x2000, 0, 0)], "pindx long, len int, ip_ihl int, ip_off int, sport int, dport int")
    assert fragments.only_fragments(short).first().plen == -1


def test_fields_filters_and_payload_lines_of_captures(spark, tmp_path):
    udp = struct.pack(">HHHH", 5, 53, 12, 258) + b"wxyz"
    (tmp_path / "a.pcap").write_bytes(capture_file(101, [ipv4(17, udp), ipv4(6, struct.pack(">HHIIBBHHH", 1234, 23, 9, 8, 0x50, 2, 100, 0, 0)), ipv4(17, udp)[:-2]]))
    got = capture.read_pcap(spark, str(tmp_path), fields=["ttl", "ipid"], where="udp")
    assert got.columns == ["ttl", "ipid"] and [tuple(r) for r in got.collect()] == [(64, 7), (64, 7)]
    with pytest.raises(ValueError):
        capture.read_pcap(spark, str(tmp_path), fields=["nope"])
    lines = [r.line for r in tables.udp_payload_lines(capture.read_pcap(spark, str(tmp_path))).collect()]
    assert lines == ["01020304,0a010203,0005,0035,17,100.000005,0102,4,7778797a,40,0007"]
    (tmp_path / "m-2023-04-05-06-x.txt").write_text("\n".join(lines) + "\n")
    r = tables.read_udp_payloads(spark, str(tmp_path / "m-2023-04-05-06-x.txt")).first()
    assert (r.saddr, r.dport, bytes(r.payload), r.ttl, r.ts_us, r.year, r.hour, str(r.date)) == (0x01020304, 53, b"wxyz", 64, 100_000_005, 2023, 6, "2023-04-05")


def test_mixed_and_compressed_inputs(spark, tmp_path):
    import pyarrow as pa

    def lz4(raw):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as f:
            f.write(raw)
        return sink.getvalue().to_pybytes()

    p = packets(spark, [(1.5, 3000000000, 5, 6, 23), (2, 1, 4294967295, 17, 65535)]).coalesce(1)
    tables.write_packed(p, str(tmp_path / "out"))
    (name,) = [f for f in (tmp_path / "out").iterdir()]
    assert name.name == "part-00000.fc5"
    raw = name.read_bytes()
    (tmp_path / "b.fc5.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "c.fc5.lz4").write_bytes(lz4(raw))
    line = b"1,2,6,1000,23,-1,40,-1,-1,-1,1700000000.25\n"
    (tmp_path / "d.csv").write_bytes(line)
    (tmp_path / "e.csv.lz4").write_bytes(lz4(line * 3 + b"bad\n"))
    (tmp_path / "f.pcap").write_bytes(capture_file(101, [ipv4(17, struct.pack(">HHHH", 5, 53, 8, 0))]))
    paths = [str(name), *(str(tmp_path / n) for n in ("b.fc5.gz", "c.fc5.lz4", "d.csv", "e.csv.lz4", "f.pcap"))]
    assert [tables.read_packets(spark, x).count() for x in paths] == [2, 2, 2, 1, 3, 1]
    merged = tables.read_packets(spark, paths)
    assert merged.count() == 11 and counts.count_query(merged, "P", 10**9).agg(F.sum("n")).first()[0] == 11
    assert merged.orderBy("ts_us").first().ts_us == 1_500_000
    with pytest.raises(ValueError):
        tables.read_packets(spark, "x.unknown")


def test_strict_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,2,6,1000,23,-1,40,-1,-1,-1,1700000000.25\n1,2,17,1,53,-1,40,-1,-1,-1,17\n1,x,17,1,53,-1,40,-1,-1,-1,17.5\n")
    path = str(tmp_path / "p.csv")
    assert tables.read_packets(spark, path).count() == 1 and tables.rejected_rows(spark, path).first().n == 2
    with pytest.raises(Exception, match="not a packet"):
        tables.read_packets(spark, path, strict=True).collect()


def test_scan_records(spark, tmp_path):
    p = packets(spark, [(k * 0.01, 9, 256 + (k * 37) % 256, 6, 23) for k in range(256)]).withColumn("ttl", (50 + F.col("pindx") % 3).cast("int"))
    found = scans.horizontal_scans(p, 24, 60)
    text = "\n".join(r.line for r in tables.scan_record_lines(found).collect()) + "\n"
    (tmp_path / "s.txt").write_text(text + text)
    back = tables.read_scan_records(spark, str(tmp_path / "s.txt"))
    assert back.count() == 2 and back.first().offs == found.first().offs and back.first().cnt == 256
    assert {tuple(r)[-2:] for r in ttl_shapes.describe(back).collect()} == {tuple(r)[-2:] for r in ttl_shapes.describe(found).collect()}


def test_total_lines_and_year_months(spark):
    p = packets(spark, [(t, 1, 2, 6, 23) for t in (0, 1, 20, 21)])
    assert sorted(r.line for r in counts.total_lines(p, "S24A", 10).collect()) == ["T,0,start_time,10,S24A", "T,2,start_time,0,S24A", "T,2,start_time,20,S24A"]
    assert [r.line for r in counts.total_lines(p.where("false"), "PA").collect()] == ["T,0,start_time,0,PA"]
    p = packets(spark, [(0, 1, 2, 6, 23), (40 * 86400, 3, 2, 6, 23), (41 * 86400, 4, 2, 6, 23)])
    r = places.year_stats(p, ["saddr"], months=None).first()
    assert (r.n, r.n_saddr, r.m_saddr) == (3, 3, 1.5) and places.year_stats(p, ["saddr"]).first().m_saddr == 0.25


def test_port_of_day_rules(spark):
    from darkspace.operators import daily_port

    rows = [(h * 3600 + k, (k + 1) << 8, 9, 17, 50000 + (h > 11)) for h in range(21) for k in range(3)] + [(86400 + h * 3600, 1 << 8, 9, 17, 50000) for h in range(20)]
    p = packets(spark, rows)
    assert [(r.day, r.dport) for r in daily_port.port_of_day(p).collect()] == [(0, 50001)]  # 27 packets of 3 sources against 36
    assert [(r.day, r.dport, r.npkts) for r in daily_port.port_of_day(p, hours=[0, 1]).collect()] == [(0, 50000, 6)]
    assert daily_port.port_of_day(p, least_hours=1).count() == 2


def test_membership_by_predicate_and_join(spark):
    rows = packets(spark, [(0, k << 24, 2, 6, 1) for k in range(1, 220)] + [(0, None, 2, 6, 1)])
    for nets in (["10.0.0.0/8"], [f"{k}.0.0.0/17" for k in range(1, 200)]):
        inside = net.with_membership(rows, "saddr", nets, "known")
        assert inside.count() == 220 and inside.where("known").count() == len(nets) and inside.where("known is null").count() == 0
        trend = ingest.scanner_trend(rows.where("saddr is not null"), nets, ["S8"], 100, 1000)
        assert {(r.subset, r.k) for r in trend.groupBy("subset").agg(F.sum("n").alias("k")).collect()} == {("all", 219), ("ack", len(nets)), ("nack", 219 - len(nets))}


def test_busy_port_is_many_windows(spark):
    rng = random.Random(6)
    ports = [rng.choice((80, 80, 80, 81, 82)) for _ in range(700)]
    p = packets(spark, [(k // 3, k % 7, 2, 17, a) for k, a in enumerate(ports)])
    got = {r.pindx: r.interest for r in behaviour.port_interest(p, 20, block=50).collect()}
    assert len(got) == 700
    for k, a in enumerate(ports):
        before = ports[max(0, k - 20) : k]
        assert got[k] == pytest.approx(before.count(a) / len(before) if before else 0.0)


def test_clusters_hold_half_of_the_matrix(spark):
    g = np.random.default_rng(6)
    x = g.integers(0, 40, (600, 2)).astype(float)  # many equal distances
    m = np.linalg.norm(x[:, None] - x[None], axis=2)
    tracemalloc.start()
    labels = behaviour.agglomerate(m, clusters=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * 600 * 600  # bytes a pair, either way round
    d, members = m.copy(), {k: [k] for k in range(600)}
    np.fill_diagonal(d, np.inf)
    while len(members) > 5:  # the first of the least distances of the whole matrix, every time
        i, j = np.unravel_index(np.argmin(d), d.shape)
        a, b = len(members[i]), len(members[j])
        row = (a * d[i] + b * d[j]) / (a + b)
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        members[i] += members.pop(j)
    assert {tuple(sorted(v)) for v in members.values()} == {tuple(np.flatnonzero(labels == k).tolist()) for k in range(5)}

    values = spark.createDataFrame([(s, k, *map(float, r)) for s in range(90) for k, r in enumerate(g.random((2 + s % 4, 10)))] + [(1000, 0, *[0.0] * 10)], [c.split()[0] for c in behaviour.COMPONENTS.split(", ")])
    of_pairs = behaviour.clusters(behaviour.distances(values, "spectral", 2), clusters=4)
    assert sorted(behaviour.spectral_clusters(values, 2, clusters=4).collect()) == sorted(of_pairs.collect())
    assert behaviour.spectral_clusters(values.where("saddr = 0"), 2).count() == behaviour.spectral_clusters(values.where("false"), 2).count() == 0


def test_clusters_of_many_sources_hold_no_matrix(monkeypatch):
    g = np.random.default_rng(8)
    for n, width, linkage, options in ((150, 3, "average", {"clusters": 4}), (150, 2, "average", {"threshold": 0.8}), (120, 2, "complete", {"clusters": 9}), (120, 1, "single", {"clusters": 5})):
        x = g.normal(size=(n, width)) * (g.pareto(1, (n, 1)) + 1)
        x[n // 2 :] = x[g.integers(0, n // 2, n - n // 2)]  # copies
        monkeypatch.setattr(behaviour, "MATRIX", n)
        whole = behaviour.merged_points(x, linkage=linkage, **options)
        monkeypatch.setattr(behaviour, "MATRIX", 12)
        monkeypatch.setattr(behaviour, "LEAF", 20)
        assert behaviour.merged_points(x, linkage=linkage, **options).tolist() == whole.tolist()
    monkeypatch.undo()
    monkeypatch.setattr(behaviour, "MATRIX", 500)
    monkeypatch.setattr(behaviour, "CELLS", 1 << 15)
    x = g.random((3000, 2))
    tracemalloc.start()
    labels = behaviour.merged_points(x, clusters=4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(labels.tolist()) == {0, 1, 2, 3} and peak < 3000 * 3000  # half of the matrix takes 4 bytes for each


def test_principal_values_of_sources_over_batches(spark, monkeypatch):
    monkeypatch.setattr(behaviour, "BATCH", 7)
    g = np.random.default_rng(9)
    own = {s: sorted((int(t), k) for k, t in enumerate(g.integers(0, 40, n))) for s, n in ((1, 3), (2, 30), (3, 6), (4, 7), (5, 8), (6, 25))}
    rows = {(s, *key): g.random(3).tolist() for s, keys in own.items() for key in keys}
    got = behaviour.principal_values(spark.createDataFrame([(*k, *v) for k, v in rows.items()], "saddr long, ts_us long, pindx long, f0 double, f1 double, f2 double"), 5, 9)
    want = []
    for s, keys in own.items():
        for k in range(7, len(keys)):
            times = np.array([t for t, _ in keys[k - 4 : k + 1]], float)
            values = np.array([rows[s, *key] for key in keys[k - 4 : k + 1]])
            x = np.stack([np.interp(np.linspace(times[0], times[-1], 9), times, v) for v in values.T], 1)
            x = x / np.linalg.norm(x, axis=0)
            want.append((s, times[-1], *np.linalg.svd(x - x.mean(0))[1]))
    assert np.allclose(sorted(tuple(r)[:5] for r in got.collect()), sorted(want))


def test_hausdorff_by_products_is_fast_and_exact(monkeypatch):
    g = np.random.default_rng(10)
    series = [g.normal(size=(int(n), 10)) * 10.0 ** g.integers(-3, 3) for n in g.integers(1, 40, 24)]
    series += [series[0].copy(), series[1] + 1e-7, series[2][::-1].repeat(3, axis=0)]  # equal, close, equal in another order
    for tile in (1, 300, 5000, 1 << 17):
        monkeypatch.setattr(behaviour, "TILE", tile)
        got = behaviour.hausdorff_block(series, series[3:] + series[:3])
        want = np.array([[behaviour.hausdorff(a, b) for b in series[3:] + series[:3]] for a in series])
        assert np.allclose(got, want, rtol=1e-9, atol=0)
    series[0][0, 0] = np.inf
    assert np.array_equal(behaviour.hausdorff_block(series[:2], series[:2]), behaviour.differences_block(series[:2], series[:2]), equal_nan=True)

    def seconds(f):
        began = time.perf_counter()
        f(many, many)
        return time.perf_counter() - began

    many = [g.random((17, 10)) for _ in range(150)]
    assert min(seconds(behaviour.hausdorff_block) for _ in range(3)) < 0.7 * min(seconds(behaviour.differences_block) for _ in range(3))


def test_feature_plugins_scores_and_centroids(spark):
    p = packets(spark, [(k * (1 + k % 3), k % 2, 2, 17, 50 + k % 4) for k in range(60)])
    plugins = {"ttl": lambda w: F.col("ttl"), "step": lambda w: F.coalesce(F.col("dport") - F.lag("dport").over(w), F.lit(0))}
    rows = behaviour.features(p, plugins=plugins)
    assert rows.columns[-2:] == ["f5", "f6"] and {r.f5 for r in rows.collect()} == {64.0} and {r.f6 for r in rows.collect()} <= {0.0, 2.0, -2.0}
    values = behaviour.principal_values(rows, 6, 8)
    assert values.columns == ["saddr", "ts_us", *(f"val{k}" for k in range(7)), *(f"delta{k}" for k in range(7))] and values.count() == 2 * (30 - 8)
    assert behaviour.distances(values, "spectral").count() == 1 and behaviour.distances(values, "hausdorff", 23).count() == 0
    x = {1: 0.0, 2: 0.1, 3: 5.0, 4: 5.1}
    pairs = spark.createDataFrame([(a, b, abs(x[a] - x[b])) for a in x for b in x if a < b], "a long, b long, distance double")
    labels = behaviour.clusters(pairs, clusters=2)
    r = behaviour.cluster_scores(pairs, labels).first()
    m = np.array([[abs(x[a] - x[b]) for b in x] for a in x])
    assert r.clusters == 2 and r.silhouette == pytest.approx(behaviour.silhouette(m, np.array([0, 0, 1, 1]))) and r.davies_bouldin == pytest.approx(behaviour.davies_bouldin(m, np.array([0, 0, 1, 1])))
    assert behaviour.cluster_scores(pairs, behaviour.clusters(pairs, clusters=1)).first().silhouette is None
    marks = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 0.0), (1, 1.0, 3.0), (2, 1.0, -4.0)], "label long, u double, v double")
    assert {(r.a, r.b, r.distance) for r in behaviour.centroid_distances(marks, ["u", "v"]).collect()} == {(0, 1, 3.0), (0, 2, 4.0), (1, 2, 7.0)}


def test_parameters(tmp_path):
    from darkspace.parameters import Parameters

    (tmp_path / "p").write_text("# comment\nROOT=/data\nexport OUT=\"$ROOT/out ${ROOT}\"  # tail\nRAW='$ROOT'\nNETS=\"10.0.0.0/8 11.0.0.0/8\"\n\nEMPTY=\n")
    p = Parameters.read(str(tmp_path / "p"), HOURS="4")
    assert dict(p) == {"HOURS": "4", "ROOT": "/data", "OUT": "/data/out /data", "RAW": "$ROOT", "NETS": "10.0.0.0/8 11.0.0.0/8", "EMPTY": ""}
    assert p.words("NETS") == ["10.0.0.0/8", "11.0.0.0/8"] and p.words("NONE") == []
    with pytest.raises(ValueError):
        Parameters.parse("rm -rf x")


def test_writers(spark, tmp_path):
    p = packets(spark, [(t, 1, (10 << 24) + 256 * (t % 2), 6, 23) for t in range(10)])
    ingest.write_by_spans(p, [(0, 5, "a"), (3, 20, "b"), (90, 99, "c")], str(tmp_path / "spans"))
    back = spark.read.parquet(str(tmp_path / "spans"))
    assert {(r.span, r["count"]) for r in back.groupBy("span").count().collect()} == {("a", 5), ("b", 7)}
    ingest.write_by_destination(p, str(tmp_path / "nets"))
    assert {(r.dst_net, r["count"]) for r in spark.read.parquet(str(tmp_path / "nets")).groupBy("dst_net").count().collect()} == {(10 << 24, 5), ((10 << 24) + 256, 5)}


def test_exchange_inversions_are_swaps(monkeypatch):
    rng = random.Random(8)
    for n in range(200):
        monkeypatch.setattr(scans, "SHORT", 0 if n % 2 else 200)
        values = [rng.randrange(6) for _ in range(rng.randrange(9))]
        a, swaps = list(values), 0
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                if a[j] < a[i]:
                    a[i], a[j], swaps = a[j], a[i], swaps + 1
        assert scans.exchange_inversions(values) == swaps
        assert scans.inversions(values) == sum(x > y for k, x in enumerate(values) for y in values[k:])


def stream(spark, tmp_path, files, schema):
    """A source that gives one file a batch, in order."""
    import os
    import time

    (tmp_path / "in").mkdir()
    for k, p in enumerate(files):
        p.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (part,) = (tmp_path / f"part{k}").glob("*.parquet")
        os.rename(part, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run_stream(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_late_packets_are_left_out_once_the_watermark_has_passed(spark, tmp_path):
    batches = [[(0, 1, 2, 6, 23), (70, 1, 2, 6, 23)], [(30, 1, 2, 6, 23), (4000, 1, 2, 6, 23)], [(8000, 1, 2, 6, 23)], [(40, 1, 2, 6, 23), (8001, 1, 2, 6, 23)], [(8002, 1, 2, 6, 23)]]
    files = [packets(spark, b) for b in batches]
    counted = streaming.stream_counts(stream(spark, tmp_path, files, files[0].schema), "P", "1 minute", "10 minutes")
    run_stream(counted, tmp_path, "late")
    assert sorted((r.start, r.n) for r in spark.table("late").collect()) == [(0, 2), (60, 1), (3960, 1)]  # the second late packet came after 3400


def test_scan_state_expires(spark, tmp_path):
    half = [(k * 0.1, 1, k, 6, 23) for k in range(4)]
    batches = [half, [(5000, 9, 0, 6, 23)], [(5001, 9, 1, 6, 23)], [(10_000 + k, 1, k, 6, 23) for k in range(4, 8)], [(90_000, 9, 0, 6, 23)], [(90_001, 9, 1, 6, 23)]]
    files = [packets(spark, b) for b in batches]
    query = run_stream(streaming.stream_scans(stream(spark, tmp_path, files, files[0].schema), 29, 10, late="1 second"), tmp_path, "expired")
    assert spark.table("expired").count() == 0
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) <= 2 and held[-1] == 1  # source 1 is forgotten each time


def test_image_tables(spark):
    p = packets(spark, [(100 * s + k * 0.01, 9 + s, 256 + (k * 37) % 256, 6, 23) for s in range(3) for k in range(256)])
    p = p.withColumn("ttl", (50 + F.col("daddr") % 2 + F.when(F.col("saddr") == 11, F.col("daddr") % 3).otherwise(0)).cast("int"))
    shapes = ttl_shapes.describe(scans.horizontal_scans(p, 24, 60))
    images, instances, labels = ttl_shapes.catalog_tables(shapes)
    assert sorted((r.first_src, r.n) for r in images.collect()) == [(9, 2), (11, 1)]
    assert instances.count() == 3 and instances.where("image_id is null").count() == 0 and instances.where("src = 9").first().ttls == "[50,51]"
    expected = {(r.nhash, t, x) for r in shapes.collect() for t, found in r.pattern.items() for x in found}
    assert {(r.nhash, r.ttl, r.label) for r in labels.collect()} == expected != set()
    assert [r.n for r in ttl_shapes.common_shapes(shapes, 1).collect()] == [2]
