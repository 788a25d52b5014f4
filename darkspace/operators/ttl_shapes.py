"""Symmetry patterns in the time-to-live values of complete /24 scans."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names of the six tests, in the order of the tests, and the twelve pairs of quadrants that labels name.
TESTS = ("S", "MUD", "MLR", "R90", "R180", "R270")
PAIRS = ("AB", "AC", "CD", "DB", "AD", "BC", "AnB", "AnC", "CnD", "DnB", "AnD", "BnC")
LEAST, FAR = 16, 4
SHAPES = "src long, dst long, start double, elapsed double, proto int, dport int, max_ttl int, min_ttl int, ttl_cnt int, pattern map<int,array<string>>, dhash string, nhash string"


def grid(offsets, values, empty: int = 1) -> np.ndarray:
    """16 x 16 by offset; later probes overwrite."""
    out = np.full(256, empty)
    for off, value in zip(offsets, values, strict=True):
        out[off] = value
    return out.reshape(16, 16)


def first_values(offsets, values) -> list[int]:
    """The value of the first probe of each of the 256 offsets, -1 where there is none."""
    out = np.full(256, -1)
    places, first = np.unique(np.asarray(offsets), return_index=True)
    out[places] = np.asarray(values)[first]
    return out.tolist()


def _quadrants(pair: str) -> tuple[str, str]:
    """The quadrant that is flipped and turned, and the one it is held against, in the order of the page."""
    low, high = sorted((pair[0], pair[-1]))
    return low, high


def patterns(matrix: np.ndarray, corrected: bool = False) -> dict[int, list[str]]:
    """Sorted labels by threshold: pairs of quadrants of which the first, flipped or turned, is like the second, up to FAR cells.

    Only grids in which two values or more occur over LEAST times count. A
    quadrant takes part if over 8 of its cells are above and over 8 are not.
    With "n" in the pair, the second quadrant is held against inverted. The
    names of the two flips are exchanged unless ``corrected``.
    """
    values, counts = np.unique(matrix, return_counts=True)
    if (counts > LEAST).sum() < 2:
        return {}
    names = list(TESTS)
    if corrected:
        names[1], names[2] = names[2], names[1]
    out: dict[int, list[str]] = {}
    for threshold in values[:-1].tolist():
        above = matrix > threshold
        quarter = {"A": above[:8, :8], "B": above[:8, 8:], "C": above[8:, :8], "D": above[8:, 8:]}
        usable = {k: 8 < q.sum() < 56 for k, q in quarter.items()}
        found = []
        for pair in PAIRS:
            a, b = _quadrants(pair)
            if not (usable[a] and usable[b]):
                continue
            own, other = quarter[a], quarter[b] ^ ("n" in pair)
            shapes = (own, np.fliplr(own), np.flipud(own), np.rot90(own), np.rot90(own, 2), np.rot90(own, 3))
            found += [f"{name}_{pair}" for name, shape in zip(names, shapes, strict=True) if (shape ^ other).sum() <= FAR]
        if found:
            out[int(threshold)] = sorted(found)
    return out


def ranks(values: list[int]) -> list[int]:
    """Each value's place by frequency, ties by first occurrence."""
    place = {v: k for k, (v, _) in enumerate(Counter(values).most_common())}  # equal counts stay in the order of first occurrence
    return [place[v] for v in values]


def normalized(values: list[int], least: int | None = None) -> list[int]:
    """Values counted from the least TTL of the scan (by default of the values), which becomes 1."""
    least = min(values) if least is None else least
    return [v - (least - 1) for v in values]


def shape_of(offsets: list[int], ttls: list[int], corrected: bool = False) -> tuple[dict[int, list[str]], str, str]:
    """Patterns of a scan, and the SHA-1 of its ranks and of its normalised values."""
    values = first_values(offsets, ttls)
    joined = [hashlib.sha1(", ".join(map(str, x)).encode()).hexdigest() for x in (ranks(values), normalized(values, min(ttls)))]
    return patterns(grid(offsets, ttls), corrected), *joined


def describe(scans: DataFrame, corrected: bool = False, only_patterned: bool = False) -> DataFrame:
    """Patterns and hashes of scans with 256 probes and several TTL values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                offs, ttls = [int(v) for v in r.offs], [int(v) for v in r.ttls]
                shape, dhash, nhash = shape_of(offs, ttls, corrected)
                if not only_patterned or shape:
                    rows.append((r.src, r.dst, r.start, r.elapsed, r.proto, r.dport, max(ttls), min(ttls), len(set(ttls)), shape, dhash, nhash))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHAPES.replace("map<int,array<string>>", "map").split(", ")])

    usable = scans.where((F.col("cnt") == 256) & (F.size(F.array_distinct("ttls")) > 1))
    return usable.select("src", "dst", "start", "elapsed", "proto", "dport", "offs", "ttls").mapInPandas(run, SHAPES)


def catalog_tables(shapes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images (distinct hashes, first seen), instances (with their image) and patterns (a row for each label)."""
    images = shapes.groupBy("dhash", "nhash").agg(F.min_by("src", F.struct("start", "src", "dst")).alias("first_src"), F.count("*").alias("n"))
    images = images.withColumn("image_id", F.sha1(F.concat("dhash", "nhash")))
    instances = shapes.join(images.select("dhash", "nhash", "image_id"), ["dhash", "nhash"], "left").withColumn("ttls", F.to_json(F.array("min_ttl", "max_ttl"))).drop("pattern")
    labels = shapes.select("dhash", "nhash", F.explode("pattern").alias("ttl", "labels")).select("dhash", "nhash", "ttl", F.explode("labels").alias("label")).distinct()
    return images, instances, labels


def with_labels(labels: DataFrame, every: Sequence[str] = (), none: Sequence[str] = ()) -> DataFrame:
    """dhash, nhash, ttl whose labels hold all of ``every`` and none of ``none``; ``labels`` has a row for each label."""
    found = labels.groupBy("dhash", "nhash", "ttl").agg(F.collect_set("label").alias("labels"))
    wanted = F.lit(True)
    for label in every:
        wanted = wanted & F.array_contains("labels", label)
    for label in none:
        wanted = wanted & ~F.array_contains("labels", label)
    return found.where(wanted).select("dhash", "nhash", "ttl")


def common_shapes(shapes: DataFrame, more_than: int = 9) -> DataFrame:
    return shapes.groupBy("nhash").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
