"""Helpers shared by the operators: batching, names of words and array primitives."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

from ..lineage import cut  # noqa: F401

#: Bytes of text that are worked on at a time inside a Python worker.
SLICE_BYTES = 1 << 20

U64 = np.uint64
#: Base of the polynomial hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes of a long text that are cut into words at a time.
LONG = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def tidy() -> None:
    """Gives freed memory back to the system, since Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(work):
    """A function of mapInArrow that ends with ``tidy``."""

    @functools.wraps(work)
    def run(batches, *args, **options):
        yield from work(batches, *args, **options)
        tidy()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, size: int) -> int:
    """Partitions for ``size`` bytes: no fewer than the session's, and so many that a task's share stays small.

    The share grows slowly, from 8 MB at 0.1 GB to 37 MB at 30 GB and at most
    256 MB, so that very large inputs don't get too many partitions to plan.
    """
    share = min(256e6, 8e6 * max(1.0, size / 1e8) ** 0.27)
    return max(shuffle_partitions(spark), int(-(-size // share)))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column with about ``limit`` bytes each."""
    n = len(column)
    if not n:
        return
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below ``n``."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``value[i] * BASE**-i``; differences give hashes of short ranges.

    Modulo 2**64 two different ranges of 1024 bytes and more can be made to
    agree, so this is for ranges of some dozen bytes, whose equality is
    confirmed by their bytes. Words are named by ``Names`` or ``Hashes``.
    """
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    terms = values.astype(U64) + U64(1)
    terms *= powers(len(values) + 1)[1][: len(values)]
    np.cumsum(terms, out=sums[1:])
    return sums


class Names(dict):
    """Numbers 0, 1, 2, ... of words as they are first met: equal numbers mean equal words, without exception."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Hashes(dict):
    """64-bit BLAKE2b hashes of words, which agree between workers; each is computed once while it is held.

    Unlike polynomials, no two words can be made to agree by their pattern. By
    chance two of n different words do with probability n * n / 2**65.
    """

    def __init__(self, memory: int = 48 << 20):
        super().__init__()
        self.memory, self.used = memory, 0

    def __missing__(self, word: bytes) -> int:
        self.used += len(word) + 150
        if self.used > self.memory:
            self.clear()
            self.used = len(word) + 150
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, LONG bytes of it at a time."""
    at = 0
    while len(text) - at > LONG:
        found = _BLANK.search(text, at + LONG)
        if found is None:
            break
        yield text[at : found.start()].split()
        at = found.end()
    yield text[at:].split()  # of bytes: at ASCII white space only


def numbered(texts: list[bytes], names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """What ``names`` has for every word of some texts, and where each text's words begin (and, last, their number)."""
    kind = U64 if isinstance(names, Hashes) else np.int64
    parts, counts, look = [np.empty(0, kind)], [0], names.__getitem__
    for text in texts:
        n = 0
        for words in words_of(text):
            parts.append(np.fromiter(map(look, words), kind, len(words)))
            n += len(words)
        counts.append(n)
    return np.concatenate(parts), np.cumsum(counts)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, from the words' hashes (one value fewer for each further word)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= U64(BASE)
        out += hashes[k : k + n]
    return mix(out)


def window_names(numbers: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all runs of ``width``, equal for equal runs only: runs are named by doubling from those of half the length."""
    if len(numbers) < width:
        return np.empty(0, np.int64)
    names, size = numbers.astype(np.int64), 1
    while size < width:
        step = min(size, width - size)
        pairs = names[: len(names) - step] << 32 | names[step:]
        names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size += step
    return names
