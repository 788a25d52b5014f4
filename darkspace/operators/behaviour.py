"""Running features of sources, principal components, distances and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..lineage import cut

COMPONENTS = "saddr long, ts_us long, " + ", ".join(f"val{k} double" for k in range(5)) + ", " + ", ".join(f"delta{k} double" for k in range(5))
#: Sources whose distances are found at a time, and distances of rows that are held at a time.
SOURCES, CELLS = 256, 1 << 18
#: Bytes of series in a block. A task holds two blocks, and every series is sent once for each block.
BLOCK = 32 << 20
#: Packets whose windows are taken together.
BATCH = 4096
#: Squares that are found by one product.
TILE = 1 << 17
#: Clusters whose matrix is held, and points whose nearest clusters are looked for together.
MATRIX, LEAF = 4096, 256


def fingerprint(flags: Column | None = None) -> Column:
    """Port, flags (TCP only; none given: 0) and length in hexadecimal; for ICMP the code and the length."""
    tcp = F.format_string("%04x%02x%02x", "dport", F.lit(0) if flags is None else flags, F.pmod("len", F.lit(256)))
    return F.when(F.col("proto") == 6, tcp).when(F.col("proto") == 17, F.format_string("%04x%02x", "dport", F.pmod("len", F.lit(256)))).otherwise(F.format_string("%02x%02x", F.pmod("dport", F.lit(256)), F.pmod("len", F.lit(256))))


def packet_gap(packets: DataFrame) -> DataFrame:
    """gap_us since the source's packet before; 0 for its first."""
    window = Window.partitionBy("saddr").orderBy("ts_us", "pindx")
    return packets.withColumn("gap_us", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(window), F.lit(0)).cast("long"))


def _shares(text: Column) -> Column:
    """Map of each character of a fingerprint to its share."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, F.size(F.filter(letters, lambda d: d == c)) / F.size(letters))))


def entropy(text: Column) -> Column:
    """Of the characters, in nats."""
    return F.aggregate(F.map_values(_shares(text)), F.lit(0.0), lambda a, p: a - p * F.log(p))


def divergence(now: Column, before: Column) -> Column:
    """Kullback-Leibler, over the characters that both have."""
    p, q = _shares(now), _shares(before)
    shared = F.array_intersect(F.map_keys(p), F.map_keys(q))
    return F.aggregate(shared, F.lit(0.0), lambda a, c: a + F.element_at(p, c) * F.log(F.element_at(p, c) / F.element_at(q, c)))


def cosine(now: Column, before: Column) -> Column:
    p, q = _shares(now), _shares(before)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.array_intersect(F.map_keys(p), F.map_keys(q)), F.lit(0.0), lambda a, c: a + F.element_at(p, c) * F.element_at(q, c))
    return dot / (norm(p) * norm(q))


def port_interest(packets: DataFrame, last: int = 100, block: int = 100_000) -> DataFrame:
    """Share of a packet's port among the ``last`` packets of all sources before it.

    The global order is found without one sorting task: packets are counted by
    second, a running sum over seconds gives each second's first number, and
    numbers within a second come from a window by second. Numbers are cut into
    blocks, each with the ``last`` packets before it once more, so a port that
    most packets seek is many windows.
    """
    rows = packets.withColumn("_sec", F.expr("ts_us div 1000000"))
    seconds = rows.groupBy("_sec").agg(F.count("*").alias("_n"))
    seconds = seconds.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = rows.join(seconds, "_sec").withColumn("_g", F.col("_before") + F.row_number().over(Window.partitionBy("_sec").orderBy("ts_us", "pindx")))
    block = max(block, last)
    own = F.expr(f"_g div {block}")
    blocks = F.when(F.col("_g") % block >= block - last, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_block", F.explode(blocks))
    same = F.count("*").over(Window.partitionBy("_block", "dport").orderBy("_g").rangeBetween(-last, -1))
    seen = F.least(F.col("_g") - 1, F.lit(last))
    rows = rows.withColumn("interest", F.when(seen > 0, same / seen).otherwise(F.lit(0.0))).where(F.col("_block") == own)
    return rows.drop("_sec", "_before", "_g", "_block")


#: A feature by name, from the rows with their running columns (gap_us, fp, fp_before, interest, window's order).
Plugin = Callable[[WindowSpec], Column]


def features(packets: DataFrame, last: int = 100, plugins: Mapping[str, Plugin] | None = None) -> DataFrame:
    """f0 to f4 of every packet: gap, len, entropy, divergence and interest (ICMP: cosine); then those of ``plugins``, in their order.

    A plugin gets the window of a source's packets in order and gives a
    numeric Column over the packet's columns and gap_us, fp, fp_before, interest.
    """
    window = Window.partitionBy("saddr").orderBy("ts_us", "pindx")
    rows = port_interest(packet_gap(packets), last).withColumn("fp", fingerprint(F.col("tcp_flags") if "tcp_flags" in packets.columns else None))
    rows = rows.withColumn("fp_before", F.coalesce(F.lag("fp").over(window), F.col("fp")))
    fifth = F.when(F.col("proto") == 1, cosine(F.col("fp"), F.col("fp_before"))).otherwise(F.col("interest"))
    own = [(F.col("gap_us") / 1e6), F.col("len").cast("double"), entropy(F.col("fp")), divergence(F.col("fp"), F.col("fp_before")), fifth]
    own += [plugin(window).cast("double") for plugin in (plugins or {}).values()]
    return rows.select("saddr", "ts_us", "pindx", *(c.alias(f"f{k}") for k, c in enumerate(own)))


def components_of(times: np.ndarray, values: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the window's features, and those times each component's cosine with the diagonal.

    Features are interpolated at even times and scaled to unit length. A
    component's sign makes the largest entry of its left vector positive.
    """
    s, cosines = components_of_all(times[None], values[None], points)
    return s[0], cosines[0]


def components_of_all(times: np.ndarray, values: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """``components_of`` of many windows (windows x states, windows x states x features) at a time."""
    step = (times[:, -1:] - times[:, :1]) / (points - 1)
    even = times[:, :1] + np.arange(points) * step
    even[:, -1:] = times[:, -1:]
    at = (even[:, :, None] >= times[:, None]).sum(2) - 1  # as numpy.interp: the last state not after it
    after = np.minimum(at + 1, times.shape[1] - 1)
    t0, v0 = np.take_along_axis(times, at, 1), np.take_along_axis(values, at[:, :, None], 1)
    span = np.take_along_axis(times, after, 1) - t0
    slope = (np.take_along_axis(values, after[:, :, None], 1) - v0) / np.where(span > 0, span, 1)[:, :, None]
    x = slope * (even - t0)[:, :, None] + v0
    norms = np.sqrt((x**2).sum(1, keepdims=True))
    x = x / np.where(norms > 0, norms, 1)
    u, s, vt = np.linalg.svd(x - x.mean(1, keepdims=True), full_matrices=False)
    signs = np.sign(np.take_along_axis(u, np.abs(u).argmax(1)[:, None], 1)[:, 0])
    vt = vt * np.where(signs == 0, 1, signs)[:, :, None]
    return s, s * vt.sum(2) / np.sqrt(vt.shape[2])


def principal_values(rows: DataFrame, states: int = 20, points: int = 32) -> DataFrame:
    """val and delta of the last ``states`` packets, from a source's (states + 3)rd packet on; one of each for every feature.

    Windows of many sources are taken together, a batch of packets at a time;
    of a source that goes on in the next batch only the last states are held.
    """
    names = sorted((c for c in rows.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    kinds = [f"{kind}{k}" for kind in ("val", "delta") for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saddr, times, values, place = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(names))), np.empty(0, np.int64)
        for batch in (whole.slice(k, BATCH) for whole in batches for k in range(0, whole.num_rows, BATCH)):
            held, last = len(saddr), place[-1] if len(place) else 0
            saddr, times = (np.concatenate([old, batch.column(k).to_numpy()]) for k, old in enumerate((saddr, times)))
            values = np.concatenate([values, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 2 + len(names))], 1).astype(float)])
            own = saddr[held:]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            began = np.repeat(np.r_[-1 - last if held and saddr[held - 1] == own[0] else 0, starts[1:]], np.diff(np.r_[starts, len(own)]))
            place = np.concatenate([place, np.arange(len(own)) - began])
            ends = held + np.flatnonzero(place[held:] >= states + 2)
            if len(ends):
                window = ends[:, None] + np.arange(1 - states, 1)
                found = components_of_all(times[window].astype(float), values[window], points)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (saddr[ends], times[ends], *np.concatenate(found, 1).T)], ["saddr", "ts_us", *kinds])
            saddr, times, values, place = (x[-states:] for x in (saddr, times, values, place))

    rows = rows.select("saddr", "ts_us", *(F.col(c).cast("double") for c in names), "pindx").repartition("saddr").sortWithinPartitions("saddr", "ts_us", "pindx")
    return rows.mapInArrow(run, "saddr long, ts_us long, " + ", ".join(f"{c} double" for c in kinds))


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of the two directed distances, in blocks of rows."""
    forth, back = 0.0, np.full(len(b), np.inf)
    for k in range(0, len(a), 256):
        d = np.sqrt(((a[k : k + 256, None] - b[None]) ** 2).sum(2))
        forth, back = max(forth, float(d.min(1).max())), np.minimum(back, d.min(0))
    return max(forth, float(back.max()))


def spectrum(x: np.ndarray, first: int) -> np.ndarray:
    """Eigenvalues of the path graph whose edges are the steps from row to row."""
    steps = np.linalg.norm(np.diff(x, axis=0), axis=1)
    return np.linalg.eigvalsh(np.diag(steps, 1) + np.diag(steps, -1))[:first]


def hausdorff_block(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``hausdorff`` of every series of ``left`` and every one of ``right``.

    Squares come from inner products, of one series and some of ``right`` at a
    time; these are filled up to one length by their last row, which leaves the
    distance as it is. Where the result is so small beside the numbers that
    digits are lost, it is found again from differences.
    """
    squares = [np.concatenate([(x**2).sum(1) for x in side]) for side in (left, right)]
    most = max(float(s.max()) for s in squares)
    if not most < 1e300:  # or not a number
        return differences_block(left, right)
    out = np.empty((len(left), len(right)))
    order = np.argsort([len(b) for b in right], kind="stable")
    lengths = np.array([len(b) for b in right])[order]
    k, rows = 0, int(np.median([len(a) for a in left]))
    while k < len(order):
        fits = np.cumsum(np.ones(len(order) - k, np.int64)) * lengths[k:] * rows <= TILE
        some = order[k : k + max(1, int(fits.sum()))]
        long = int(lengths[k + len(some) - 1])
        y = np.stack([right[m][np.minimum(np.arange(long), len(right[m]) - 1)] for m in some], 2)  # row, column, series
        y = np.concatenate([y.transpose(1, 0, 2), np.ones((1, long, len(some))), (y**2).sum(1)[None]]).reshape(-1, long * len(some))
        for m, a in enumerate(left):
            back, forth = np.full((long, len(some)), np.inf), np.full(len(some), -np.inf)
            step = max(1, 4 * TILE // y.shape[1])
            for r in range(0, len(a), step):
                x = a[r : r + step]
                d = (np.concatenate([-2 * x, (x**2).sum(1)[:, None], np.ones((len(x), 1))], 1) @ y).reshape(len(x), long, len(some))
                forth = np.maximum(forth, d.min(1).max(0))
                back = np.minimum(back, d.min(0))
            out[m, some] = np.maximum(forth, back.max(0))
        k += len(some)
    for m, close in enumerate(out < 1e-4 * most):
        if close.any():
            out[m, close] = differences_block([left[m]], [right[k] for k in np.flatnonzero(close)])[0] ** 2
    return np.sqrt(out)


def differences_block(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``hausdorff_block`` from differences, a few rows against all of ``right`` at a time."""
    out = np.zeros((len(left), len(right)))
    columns = np.ascontiguousarray(np.concatenate(right).T)
    first = np.cumsum([0, *(len(b) for b in right)])[:-1]
    step = max(1, CELLS // columns.shape[1])
    for k, a in enumerate(left):
        back = np.full(columns.shape[1], np.inf)
        for r in range(0, len(a), step):
            d = sum((x[:, None] - y) ** 2 for x, y in zip(a[r : r + step].T, columns, strict=True))
            out[k] = np.maximum(out[k], np.minimum.reduceat(d, first, axis=1).max(0))
            back = np.minimum(back, d.min(0))
        out[k] = np.maximum(out[k], np.maximum.reduceat(back, first))
    return np.sqrt(out)


def spectral_block(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Distances of every two spectra, which have one length."""
    own = np.stack(right)
    return np.stack([np.linalg.norm(a - own, axis=1) for a in left])


def _series(values: DataFrame, kind: str, least: int | None, rows: int | None = None) -> tuple[DataFrame, int, int]:
    """saddr, x (rows of numbers one after the other, or the spectrum) of the sources with ``least`` rows; numbers of a row, and of all."""
    least = (20 if kind == "hausdorff" else 5) if least is None else least
    names = [c for c in values.columns if c.startswith(("val", "delta"))]
    series = values.groupBy("saddr").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts_us", *names))).alias("rows")).where(F.col("n") >= least)
    x = F.transform("rows", lambda r: F.array(*(r[c] for c in names)))
    if rows is not None and kind == "hausdorff":
        placed = F.array_sort(F.transform(x, lambda r, k: F.struct(F.xxhash64(k).alias("h"), r.alias("x"))))
        x = F.transform(F.slice(placed, 1, rows), lambda r: r["x"])
    series = series.select("saddr", "n", F.flatten(x).alias("x"))

    @F.pandas_udf("array<double>")
    def eigenvalues(own: pd.Series) -> pd.Series:
        return pd.Series([spectrum(np.asarray(x, float).reshape(-1, len(names)), len(x)) for x in own])

    if kind != "hausdorff":
        series = series.select("saddr", "n", eigenvalues("x").alias("x"))
    series = cut(series)  # the number of blocks needs the size of the series
    shortest = series.agg(F.min("n")).first()[0]
    if kind != "hausdorff":
        series = series.withColumn("x", F.slice("x", 1, shortest or 1))
    return series.select("saddr", "x"), len(names) if kind == "hausdorff" else shortest or 1, series.agg(F.sum(F.size("x"))).first()[0] or 0


def blocks_for(cores: int, count: int, numbers: int) -> int:
    """Blocks of ``count`` series with so many numbers: for two groups a core, if there are enough sources, and of BLOCK bytes at most."""
    blocks = 1
    while blocks * (blocks + 1) < 4 * cores and blocks * SOURCES < count:
        blocks += 1
    return max(blocks, -(-8 * numbers // BLOCK))


def distances(values: DataFrame, kind: str = "hausdorff", least: int | None = None, rows: int | None = None) -> DataFrame:
    """a, b, distance of all pairs (a < b) of sources with ``least`` rows or more (20; 5 for "spectral").

    Blocks of about BLOCK bytes of series meet blocks, each two in one group,
    so the groups grow in number with the input and not in size, and a series
    is sent as often as there are blocks. A group's pairs leave it SOURCES by
    SOURCES. The pairs themselves are the square of the sources, half of it.
    A spectrum is found once for each source, and has as many values as the
    source with the fewest rows. ``rows`` bounds a source's rows for
    "hausdorff" (the first by hash of their place); none are left out without
    it.
    """
    spark = values.sparkSession
    series, width, numbers = _series(values, kind, least, rows)
    blocks = blocks_for(spark.sparkContext.defaultParallelism, series.count(), numbers)
    own = F.pmod(F.xxhash64("saddr"), F.lit(blocks)).cast("int")
    dealt = series.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "saddr", "x")
    size = SOURCES

    def pairs(now: tuple[int, int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right = (sorted((row for row in held if row[0] == block), key=lambda row: len(row[2])) for block in now)  # those of a chunk have about one length
        for k in range(0, len(left), size):
            for m in range(k if now[0] == now[1] else 0, len(right), size):
                (_, a, x), (_, b, y) = (zip(*part, strict=True) for part in (left[k : k + size], right[m : m + size]))
                if kind == "hausdorff":
                    found = hausdorff_block([v.reshape(-1, width) for v in x], [v.reshape(-1, width) for v in y])
                else:
                    found = spectral_block(list(x), list(y))
                a, b = (v.ravel() for v in np.meshgrid(np.array(a), np.array(b), indexing="ij"))
                once = a < b if now[0] == now[1] and k == m else a != b
                yield pa.RecordBatch.from_arrays([pa.array(v[once]) for v in (np.minimum(a, b), np.maximum(a, b), found.ravel())], ["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            low, high, own, saddr = (batch.column(k).to_pylist() for k in range(4))
            x, at = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *batch.column(4).value_lengths().to_pylist()])
            for k, group in enumerate(zip(low, high, strict=True)):
                if group != now:
                    if held:
                        yield from pairs(now, held)
                    now, held = group, []
                held.append((own[k], saddr[k], x[at[k] : at[k + 1]]))
        if held:
            yield from pairs(now, held)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * blocks * (blocks + 1), 1000))
    return dealt.repartition(n, "low", "high").sortWithinPartitions("low", "high").mapInArrow(run, "a long, b long, distance double")


class Upper:
    """Distances above the diagonal, row after row: half of a matrix."""

    def __init__(self, n: int):
        rows = np.arange(n, dtype=np.int64)
        self.n, self.first = n, rows * (2 * n - rows - 3) // 2 - 1
        self.d = np.empty(n * (n - 1) // 2)

    def row(self, i: int) -> np.ndarray:
        """Distances of ``i`` to all after it."""
        return self.d[self.first[i] + i + 1 : self.first[i] + self.n]

    def places(self, i: int, others: np.ndarray) -> np.ndarray:
        """Where the distances of ``i`` to some others are."""
        return self.first[np.minimum(i, others)] + np.maximum(i, others)


def agglomerate(matrix: np.ndarray, clusters: int | None = None, threshold: float | None = None, linkage: str = "average") -> np.ndarray:
    """Labels by merging the nearest clusters until ``clusters`` are left or none is nearer than ``threshold``."""
    upper = Upper(len(matrix))
    for k in range(upper.n - 1):
        upper.row(k)[:] = matrix[k, k + 1 :]
    return merged(upper, clusters, threshold, linkage)


def merged(upper: Upper, clusters: int | None = None, threshold: float | None = None, linkage: str = "average") -> np.ndarray:
    """``agglomerate`` on half of the matrix, which is written over."""
    return labelled(upper.n, [(i, j) for i, j, _ in merges(upper, np.ones(upper.n, np.int64), clusters, threshold, linkage)])


def merges(upper: Upper, sizes: np.ndarray, clusters: int | None = None, threshold: float | None = None, linkage: str = "average") -> Iterator[tuple[int, int, float]]:
    """i, j and distance of each merge of j into i < j, nearest first.

    Each row's nearest one is remembered and looked for again only when it
    changed; of equal distances the first in the matrix is taken.
    """
    n, d = upper.n, upper.d
    least, nearest = np.full(n, np.inf), np.zeros(n, np.int64)
    alive, sizes = np.ones(n, bool), sizes.copy()

    def look(i: int) -> None:
        if i < n - 1:
            row = upper.row(i)
            k = int(row.argmin())
            least[i], nearest[i] = row[k], i + 1 + k

    for k in range(n):
        look(k)
    for _ in range(n - (clusters or 1)):
        i = int(least.argmin())
        if threshold is not None and least[i] >= threshold:
            break
        j, a = int(nearest[i]), int(sizes[i])
        yield i, j, float(least[i])
        b = int(sizes[j])
        alive[[i, j]] = False
        others = np.flatnonzero(alive)
        of_i, of_j = upper.places(i, others), upper.places(j, others)
        row = {"single": np.minimum, "complete": np.maximum, "average": lambda p, q: (a * p + b * q) / (a + b)}[linkage](d[of_i], d[of_j])
        d[of_i], d[of_j] = row, np.inf
        d[upper.first[i] + j] = least[j] = np.inf
        alive[i], sizes[i] = True, a + b
        lost = (others < j) & (nearest[others] == j) | (others < i) & (nearest[others] == i)
        nearer = (others < i) & ((row < least[others]) | (row == least[others]) & (i <= nearest[others]))
        least[others[nearer]], nearest[others[nearer]] = row[nearer], i
        least[i] = np.inf
        look(i)
        for k in others[lost & ~nearer].tolist():
            look(k)


def labelled(n: int, pairs: Iterable[tuple[int, int]]) -> np.ndarray:
    """Labels from 0 on, by the first of each cluster, after merges of these pairs."""
    into = list(range(n))

    def root(k: int) -> int:
        while into[k] != k:
            into[k] = k = into[into[k]]
        return k

    for i, j in pairs:
        i, j = sorted((root(i), root(j)))
        into[j] = i
    return np.unique([root(k) for k in range(n)], return_inverse=True)[1]


class Groups:
    """Points in clusters, with the linkage of any two of them found from the points."""

    def __init__(self, x: np.ndarray, of: np.ndarray, linkage: str):
        """``of``: each point's cluster."""
        self.linkage, order = linkage, np.argsort(of, kind="stable")
        self.x, self.ids = x[order], of[order]
        self.starts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]])
        self.sizes = np.diff(np.r_[self.starts, len(x)])
        self.ids = self.ids[self.starts]
        self.columns = np.ascontiguousarray(self.x.T)
        self.centers = np.stack([np.add.reduceat(c, self.starts) for c in self.columns], 1) / self.sizes[:, None]

    def members(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points of some clusters, and where each cluster's begin."""
        sizes = self.sizes[some]
        first = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[some] - first, sizes) + np.arange(sizes.sum()), first

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Linkages of clusters ``left`` and ``right``, some points against all of ``right`` at a time."""
        fold = {"single": np.minimum, "complete": np.maximum, "average": np.add}[self.linkage]
        (of_left, _), (of_right, first) = self.members(left), self.members(right)
        columns, own = self.columns[:, of_right], np.repeat(np.arange(len(left)), self.sizes[left])
        out = np.full((len(left), len(right)), np.inf if self.linkage == "single" else 0.0)
        step = max(1, CELLS // len(of_right))
        for k in range(0, len(of_left), step):
            d = np.zeros((len(of_left[k : k + step]), len(of_right)))
            for x, y in zip(self.columns[:, of_left[k : k + step]], columns, strict=True):
                part = x[:, None] - y
                part *= part
                d += part
            np.sqrt(d, out=d)
            if len(first) < len(of_right):
                d = fold.reduceat(d, first, axis=1)
            now = own[k : k + step]
            begin = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
            d = fold.reduceat(d, begin, axis=0) if len(begin) < len(now) else d
            out[now[begin]] = fold(out[now[begin]], d)
        return out / (self.sizes[left][:, None] * self.sizes[right]) if self.linkage == "average" else out

    def leaves(self) -> list[np.ndarray]:
        """Clusters near each other, LEAF points together."""
        out, todo = [], [np.arange(len(self.ids))]
        while todo:
            some = todo.pop()
            if len(some) == 1 or self.sizes[some].sum() <= LEAF:
                out.append(np.sort(some))
                continue
            c = self.centers[some]
            order, half = np.argsort(c[:, np.ptp(c, axis=0).argmax()], kind="stable"), len(some) // 2
            todo += [some[order[:half]], some[order[half:]]]
        return out

    def nearest(self, stale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linkage and place of the nearest of each cluster that is ``stale``; of equal ones the first.

        Two clusters are no nearer on average, or at their farthest points,
        than their centers; so leaves whose centers (for "single" points) lie
        beyond what was found are left out, and nothing else.
        """
        leaves, single = self.leaves(), self.linkage == "single"
        boxes = [self.x[self.members(some)[0]] if single else self.centers[some] for some in leaves]
        low, high = np.stack([b.min(0) for b in boxes]), np.stack([b.max(0) for b in boxes])
        least, place = np.full(len(self.ids), np.inf), np.full(len(self.ids), -1)
        for leaf in leaves:
            asked = leaf[stale[leaf]]
            if not len(asked):
                continue
            if single:
                own, first = self.members(asked)
                below, above = (f.reduceat(self.x[own], first, axis=0) for f in (np.minimum, np.maximum))
            else:
                below = above = self.centers[asked]
            gap = np.sqrt((np.maximum(np.maximum(low - above[:, None], below[:, None] - high), 0) ** 2).sum(2)) * (1 - 1e-9)
            soonest = gap.min(0)
            for k in np.argsort(soonest, kind="stable").tolist():
                if soonest[k] > least[asked].max():
                    break
                rows = asked[gap[:, k] <= least[asked]]
                if not len(rows):
                    continue
                d = self.between(rows, leaves[k])
                d[rows[:, None] == leaves[k]] = np.inf
                at = d.argmin(1)
                found, which = d[np.arange(len(rows)), at], leaves[k][at]
                better = (found < least[rows]) | (found == least[rows]) & (which < place[rows]) & (found < np.inf)
                least[rows[better]], place[rows[better]] = found[better], which[better]
        return least, place


def merged_points(x: np.ndarray, clusters: int | None = None, threshold: float | None = None, linkage: str = "average") -> np.ndarray:
    """``merged`` of points by their straight distances, without their matrix if there are more than MATRIX.

    Clusters that are each other's nearest merge in rounds, whatever else is
    nearer together: no linkage here brings a merged cluster nearer to others
    than its parts were, so the same merges come as nearest first. When MATRIX
    clusters are left, ``merges`` goes on with their matrix. Then the merges
    up to the number or distance asked for are taken, nearest first. Linkages
    within 1e-12 of each other count as equal; which of equal ones merge first
    can differ from ``merged``.
    """
    n, same = len(x), 1 + 1e-12
    if n <= MATRIX:
        upper = Upper(n)
        for k in range(n - 1):
            upper.row(k)[:] = np.linalg.norm(x[k] - x[k + 1 :], axis=1)
        return merged(upper, clusters, threshold, linkage)
    _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    of = first[of.ravel()]  # each point's cluster, named by its first point
    tree = [(int(of[k]), int(k), 0.0) for k in np.argsort(of, kind="stable") if of[k] != k]
    height, least, nearest = np.zeros(n), np.full(n, np.inf), np.full(n, -1)
    stale = np.ones(n, bool)
    while len(ids := np.unique(of)) > MATRIX:
        groups = Groups(x, of, linkage)
        d, place = groups.nearest(stale[ids])
        now = stale[ids]
        least[ids[now]], nearest[ids[now]] = d[now], ids[place[now]]
        stale[:] = False
        into, done = np.arange(n), np.zeros(n, bool)
        i, j = np.minimum(ids, nearest[ids]), np.maximum(ids, nearest[ids])
        for k in np.lexsort((j, i, least[ids])).tolist():
            a, b, h = int(i[k]), int(j[k]), least[ids[k]]
            if not (done[a] or done[b]) and h <= min(least[a], least[b]) * same:
                done[a] = done[b] = True
                into[b] = a
                height[a] = max(h, height[a], height[b])
                tree.append((a, b, float(height[a])))
        of = into[of]
        left = np.unique(of)
        stale[left] = done[left] | done[nearest[left]]
    groups = Groups(x, of, linkage)
    upper, ids, everyone = Upper(len(ids)), groups.ids, np.arange(len(ids))
    for k in range(upper.n - 1):
        upper.row(k)[:] = groups.between(everyone[k : k + 1], everyone[k + 1 :])[0]
    for a, b, h in merges(upper, groups.sizes, linkage=linkage):
        a, b = int(ids[a]), int(ids[b])
        height[a] = max(h, height[a], height[b])
        tree.append((a, b, float(height[a])))
    tree.sort(key=lambda m: m[2])
    return labelled(n, ((a, b) for a, b, h in tree[: n - (clusters or 1)] if threshold is None or h < threshold))


def mean_shift(x: np.ndarray, bandwidth: float | None = None, quantile: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Labels by moving every point to the mean of its neighbours until it rests."""
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if bandwidth is None:
        bandwidth = float(np.sort(gaps, axis=1)[:, max(1, int(len(x) * quantile)) - 1].mean()) or 1.0
    at = x.copy()
    for _ in range(rounds):
        near = np.sqrt(((at[:, None] - x[None]) ** 2).sum(2)) <= bandwidth
        moved = near @ x / near.sum(1, keepdims=True)
        if np.abs(moved - at).max() < 1e-3 * bandwidth:
            break
        at = moved
    labels, centers = np.full(len(x), -1), []
    for k in range(len(x)):
        for label, center in enumerate(centers):
            if np.linalg.norm(at[k] - center) < bandwidth:
                labels[k] = label
                break
        else:
            labels[k] = len(centers)
            centers.append(at[k])
    return labels


def spectral(matrix: np.ndarray, clusters: int, seed: int = 0) -> np.ndarray:
    """Labels by k-means on the leading eigenvectors of the affinity 1 - d / max."""
    affinity = 1 - matrix / max(float(matrix.max()), 1e-12)
    root = 1 / np.sqrt(affinity.sum(1))
    vectors = np.linalg.eigh(affinity * root[:, None] * root[None])[1][:, -clusters:]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centers = [vectors[rng.integers(len(vectors))]]
    while len(centers) < clusters:
        centers.append(vectors[np.argmax(np.min([((vectors - c) ** 2).sum(1) for c in centers], axis=0))])
    centers = np.array(centers)
    for _ in range(100):
        labels = ((vectors[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([vectors[labels == k].mean(0) if (labels == k).any() else centers[k] for k in range(clusters)])
        if np.allclose(moved, centers):
            break
        centers = moved
    return labels


def silhouette(matrix: np.ndarray, labels: np.ndarray) -> float:
    scores = []
    for k, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != k)
        others = [matrix[k][labels == o].mean() for o in set(labels.tolist()) - {int(own)}]
        if not same.any() or not others:
            scores.append(0.0)
            continue
        a, b = matrix[k][same].mean(), min(others)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    kinds = sorted(set(labels.tolist()))
    centers = np.array([x[labels == k].mean(0) for k in kinds])
    spread = np.array([np.linalg.norm(x[labels == k] - c, axis=1).mean() for k, c in zip(kinds, centers, strict=True)])
    gaps = np.linalg.norm(centers[:, None] - centers[None], axis=2)
    np.fill_diagonal(gaps, np.inf)
    return float(((spread[:, None] + spread[None]) / gaps).max(1).mean()) if len(kinds) > 1 else 0.0


def clusters(pairs: DataFrame, kind: str = "agglomerative", **options) -> DataFrame:
    """saddr, label from distances of all pairs.

    A merge or move looks at all distances, so one task holds the matrix of
    all sources: 8 bytes a pair, and the pairs beside it (1500 sources: 18 MB).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.union1d(pdf["a"], pdf["b"])
        m = np.zeros((len(names), len(names)))
        a, b = np.searchsorted(names, pdf["a"]), np.searchsorted(names, pdf["b"])
        m[a, b] = m[b, a] = pdf["distance"]
        labels = {"agglomerative": agglomerate, "mean_shift": mean_shift, "spectral": spectral}[kind](m, **options)
        return pd.DataFrame({"saddr": names, "label": labels})

    return pairs.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "saddr long, label long")


def spectral_clusters(values: DataFrame, least: int | None = None, **options) -> DataFrame:
    """``clusters`` of ``distances`` of kind "spectral", by ``merged_points``, without the pairs.

    One task gets the spectra and holds them and half of the matrix of at most
    MATRIX clusters.
    """
    series, width, _ = _series(values, "spectral", least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saddr, x = [np.empty(0, np.int64)], [np.empty((0, width))]
        for batch in batches:
            saddr.append(batch.column(0).to_numpy())
            x.append(batch.column(1).flatten().to_numpy().reshape(-1, width))
        names, own = np.concatenate(saddr), np.concatenate(x)
        order = np.argsort(names)
        if len(names) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(names[order]), pa.array(merged_points(own[order], **options).astype(np.int64))], ["saddr", "label"])

    return series.repartition(1).mapInArrow(run, "saddr long, label long")


def cluster_scores(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """clusters, silhouette and davies_bouldin of labels, from the rows of the distance matrix; null for fewer than two clusters.

    As in ``clusters`` one task holds the matrix.
    """
    dealt = pairs.select("a", "b", "distance", F.lit(None).cast("long").alias("label")).union(labels.select(F.col("saddr"), F.lit(None).cast("long"), F.lit(None).cast("double"), "label"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf[pdf["label"].notna()].sort_values("a")
        names, own = named["a"].to_numpy(), named["label"].to_numpy().astype(int)
        both = pdf[pdf["label"].isna()]
        m = np.zeros((len(names), len(names)))
        a, b = np.searchsorted(names, both["a"]), np.searchsorted(names, both["b"].astype("int64"))
        m[a, b] = m[b, a] = both["distance"]
        several = len(set(own.tolist())) > 1
        return pd.DataFrame({"clusters": [len(set(own.tolist()))], "silhouette": [silhouette(m, own) if several else None], "davies_bouldin": [davies_bouldin(m, own) if several else None]})

    return dealt.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "clusters long, silhouette double, davies_bouldin double")


def centroids(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy("label").agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def centroid_distances(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, distance between the centroids of every two labels (a < b), of which there are few."""
    means = centroids(rows, columns)
    left, right = means.select(F.col("label").alias("a"), F.array(*columns).alias("x")), means.select(F.col("label").alias("b"), F.array(*columns).alias("y"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", gap.alias("distance"))
