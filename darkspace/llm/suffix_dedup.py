"""Removal of repeated byte strings with per-shard suffix arrays, exact over all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, as_bytes, cut, mix, partitions_for, powers, prefix_sums, slices, tidied

#: A string of LENGTH bytes holds LENGTH - GRAM + 1 grams, of which the least by hash is its anchor.
LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
PIECE = REACH + LENGTH
#: Bytes of candidate text to a shard, and of whole texts held meanwhile.
SHARD, HELD = 1 << 20, 12 << 20
#: Bytes of text whose anchors are found at a time.
READ = 1 << 19
#: Pieces that are merged at a time (all of an anchor together).
MERGED = 1 << 13
EMPTY = hashlib.sha256(b"").hexdigest()
HASH_BYTES = 5


# -- anchors: which grams can lie in a repeated string ------------------------------------------


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some LENGTH-byte string of ``buffer``.

    Equal strings have equal anchors at equal offsets (all of them, on ties).
    """
    n = len(buffer) - GRAM + 1
    if len(buffer) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, U64)
    sums = prefix_sums(buffer)
    hashes = mix((sums[GRAM:] - sums[:n]) * powers(len(sums))[0][:n])
    least = _sliding(hashes, REACH + 1, np.minimum)
    edge = np.zeros(REACH, U64)
    places = np.flatnonzero(hashes == _sliding(np.concatenate((edge, least, edge)), REACH + 1, np.maximum))
    return places, hashes[places]


def _anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of several texts.

    Strings that would span two texts can only add anchors to those a text has by itself.
    """
    ends = np.cumsum([len(t) for t in texts])
    places, hashes = anchors(np.frombuffer(b"".join(texts), np.uint8))
    owner = np.searchsorted(ends, places, "right")
    whole = places + GRAM <= ends[owner] if len(places) else np.empty(0, bool)
    return owner[whole], (places - (ends - [len(t) for t in texts])[owner])[whole], hashes[whole]


def _short(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash and what tells it from others there (HASH_BYTES of it)."""
    return (hashes % U64(buckets)).astype(np.int64), (hashes >> U64(64 - 8 * HASH_BYTES)).astype(U64)


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel().astype(U64)


@tidied
def _offer(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(cid, text) to packed (bucket, cids, counts, hashes); equal texts are offered once a task."""
    seen: set[int] = set()
    names = ["bucket", "cids", "counts", "hashes"]
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        parts: dict[int, list[list]] = {}
        for cids, bucket, short, owner in held:
            order = np.lexsort((short, owner, bucket))
            bucket, short, owner = bucket[order], short[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]) | (short[1:] != short[:-1])
            bucket, short, owner = bucket[new], short[new], owner[new]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    at = slice(cuts[b], cuts[b + 1])
                    who, counts = np.unique(owner[at], return_counts=True)
                    kept = parts.setdefault(b, [[], [], []])
                    kept[0].append(cids[who].tobytes())
                    kept[1].append(counts.astype(np.uint32).tobytes())
                    kept[2].append(_pack(short[at]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), *(pa.array([b"".join(p[k]) for p in parts.values()], pa.binary()) for k in range(3))], names)

    for batch in batches:
        for start, stop in slices(batch.column(1), READ):
            cids, texts = [], []
            for cid, text in zip(batch.column(0)[start:stop].to_pylist(), as_bytes(batch.column(1)[start:stop]), strict=True):
                if cid not in seen and len(text) >= LENGTH:
                    seen.add(cid)
                    cids.append(cid)
                    texts.append(text)
            if texts:
                owner, _, hashes = _anchors_of(texts)
                held.append((np.array(cids, np.int64), *_short(hashes, buckets), owner))
                size += sum(map(len, texts))
            if size >= 8 << 20:
                yield flush()
                size = 0
    if held:
        yield flush()


@tidied
def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each text of a bucket those of its hashes that another text has too."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        cids = np.repeat(np.frombuffer(b"".join(h[0] for h in held), np.int64), np.frombuffer(b"".join(h[1] for h in held), np.uint32))
        hashes = np.concatenate([_unpack(h[2]) for h in held])
        held.clear()
        order = np.argsort(hashes)
        cids, hashes = cids[order], hashes[order]
        head = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        shared = np.minimum.reduceat(cids, head) != np.maximum.reduceat(cids, head)
        keep = np.repeat(shared, np.diff(np.append(head, len(hashes))))
        cids, hashes = cids[keep], hashes[keep]
        order = np.argsort(cids, kind="stable")
        cids, hashes = cids[order], hashes[order]
        head = np.flatnonzero(np.concatenate(([True], cids[1:] != cids[:-1]))) if len(cids) else np.empty(0, np.int64)
        stops = np.append(head[1:], len(cids))
        raw = _pack(hashes)
        for k in range(0, len(head), 20_000):
            spans = zip(head[k : k + 20_000].tolist(), stops[k : k + 20_000].tolist(), strict=True)
            packed = [np.int64(now).tobytes() + raw[a * HASH_BYTES : b * HASH_BYTES] for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(cids[head[k : k + 20_000]]), pa.array(packed, pa.binary())], ["cid", "pack"])

    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from flush()
                now = bucket
            held.append(row)
    yield from flush()


# -- a shard's suffix array ----------------------------------------------------------------------


def _narrow(n: int) -> type:
    """A type for places below ``n`` and sums of two of them: arrays of places are most of a shard's memory."""
    return np.int32 if n < 1 << 30 else np.int64


def suffix_array(text: np.ndarray, bits: int = 9) -> np.ndarray:
    """The suffixes of ``text`` (symbols of so many bits; at its end no more than one 0) in order.

    Larsson and Sadakane's refinement: suffixes are sorted by as many symbols as a key holds;
    then, while a group of equal ones has several members, its members are
    sorted by the group of the suffix that begins where the compared part
    ends, so the compared depth doubles; groups of one are not touched again.
    """
    n, first = len(text), 63 // bits
    kind = _narrow(n)
    padded = np.concatenate((text, np.zeros(first, text.dtype)))
    keys = np.zeros(n, np.int64)
    for k in range(first):
        keys <<= bits
        np.bitwise_or(keys, padded[k : k + n], out=keys, casting="unsafe")
    del padded
    order = np.argsort(keys).astype(kind)
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).astype(kind)
    del keys
    rank = np.empty(n, kind)
    sizes = np.diff(np.append(head, kind(n)))
    rank[order] = np.repeat(head, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes)).astype(kind)
    reached = first
    while len(slots):
        members = order[slots]
        beyond = members + kind(reached)
        pairs = rank[members].astype(np.int64)
        pairs <<= 32
        pairs |= np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        del beyond
        inner = np.argsort(pairs)
        members, pairs = members[inner], pairs[inner]
        del inner
        order[slots] = members
        head = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        sizes = np.diff(np.append(head, len(slots)))
        rank[members] = np.repeat(slots[head], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        reached *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Length, up to ``most``, of the prefix that each suffix in order shares with the one before.

    Kasai's scan in text order, in which a length falls by at most one from a
    place to the next; lanes of ``lane`` places run side by side.
    """
    n = len(text)
    before = np.empty(n, _narrow(n))
    before[order[:1]] = -1
    before[order[1:]] = order[:-1]
    padded = np.concatenate((text.astype(np.int32), np.full(most + 1, -1, np.int32)))
    other = np.concatenate((text.astype(np.int32), np.full(most + 1, -2, np.int32)))
    starts = np.arange(0, n, lane)
    length = np.zeros(len(starts), np.int64)
    out = np.zeros(n, np.min_scalar_type(most))
    for step in range(lane):
        at = starts + step
        live = at < n
        at, length = at[live], length[live]
        starts = starts[live]
        length = np.maximum(length - 1, 0)
        partner = before[at]
        length[partner < 0] = 0
        grow = np.flatnonzero(partner >= 0)
        while len(grow):
            more = length[grow]
            same = (more < most) & (padded[at[grow] + more] == other[partner[grow] + more])
            grow = grow[same]
            length[grow] += 1
        out[at] = length
    return out[order]


# -- shards: repeats within, pieces for the others -----------------------------------------------


class Shard:
    """Documents with their candidate text, until they are sorted."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.docs: list[tuple] = []
        self.candidate = self.held = 0

    def add(self, doc_id: int, text: bytes, places: np.ndarray, hashes: np.ndarray, shared: np.ndarray) -> None:
        """``places``: all anchors; ``shared``: which of them another document has too."""
        own = places[shared]
        spans = _union(np.maximum(own - REACH, 0), np.minimum(own + LENGTH, len(text)))
        first, last = _turns(places, hashes, len(text))
        self.docs.append((doc_id, text, own, hashes[shared], first[shared], last[shared], spans))
        self.candidate += int((spans[:, 1] - spans[:, 0]).sum())
        self.held += len(text)

    def solve(self) -> tuple[list[np.ndarray], dict[int, list]]:
        """For each document its starts of strings that a smaller document of the shard has; pieces by bucket."""
        regions, origin, owner = [], [], []
        for k, (_, text, *_, spans) in enumerate(self.docs):
            raw = np.frombuffer(text, np.uint8)
            for a, b in spans.tolist():
                regions += [raw[a:b].astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)]
                origin.append(a)
                owner.append(k)
        text = np.concatenate(regions)
        sizes = np.fromiter(map(len, regions), np.int64, len(regions)).reshape(-1, 2).sum(1)
        del regions
        kind = _narrow(len(text))
        begin = np.cumsum(sizes) - sizes
        doc = np.repeat(np.array(owner, kind), sizes)
        place = np.arange(len(text), dtype=kind)  # of the text; less its offset, of the document
        to_end = np.repeat((begin + sizes - 1).astype(kind), sizes) - place
        place -= np.repeat((begin - np.array(origin)).astype(kind), sizes)
        order = suffix_array(text)
        classes = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH, dtype=kind)
        # documents by the order of their ids: equal ids have equal numbers
        ids = np.unique(np.array([d[0] for d in self.docs], np.int64), return_inverse=True)[1].astype(kind)
        valid = to_end[order] >= LENGTH
        del to_end
        order, classes = order[valid], classes[valid]
        del valid
        covered: list[np.ndarray] = [np.empty(0, np.int64)] * len(self.docs)
        free = np.zeros(len(text), bool)  # strings that no smaller document of the shard has
        if len(order):
            head = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
            del classes
            names = ids[doc[order]]
            later = names > np.repeat(np.minimum.reduceat(names, head), np.diff(np.append(head, len(order))))
            del names, head
            free[order[~later]] = True
            hit = np.sort(order[later])
            del order, later
            cuts = np.searchsorted(doc[hit], np.arange(len(self.docs) + 1))
            covered = [place[hit[cuts[k] : cuts[k + 1]]] for k in range(len(self.docs))]
        return covered, self._pieces(free, doc, place)

    def _pieces(self, free: np.ndarray, doc: np.ndarray, place: np.ndarray) -> dict[int, list]:
        """Bytes around the anchors that lie in a string which only other shards can have before."""
        out: dict[int, list] = {}
        cuts = np.searchsorted(doc[free], np.arange(len(self.docs) + 1))
        free_places = place[free]
        for k, (doc_id, text, places, hashes, first, last, _) in enumerate(self.docs):
            own = free_places[cuts[k] : cuts[k + 1]]
            a, b = np.searchsorted(own, first), np.searchsorted(own, last, "right")
            needed = np.flatnonzero(a < b)
            if not len(needed):
                continue
            places, first, last = places[needed], own[a[needed]], own[b[needed] - 1]
            buckets = ((hashes[needed] >> U64(8)) % U64(self.buckets)).astype(np.int64)
            raw = np.frombuffer(bytes(REACH) + text + bytes(LENGTH), np.uint8)
            left, right = (places - first).astype(np.uint8), (last + LENGTH - places).astype(np.uint8)
            column = np.arange(PIECE)
            inside = (column >= REACH - left[:, None].astype(int)) & (column < REACH + right[:, None].astype(int))
            grid = np.lib.stride_tricks.sliding_window_view(raw, PIECE)[places] * inside
            for b in np.unique(buckets).tolist():
                at = buckets == b
                rows = out.setdefault(b, [[], [], [], [], []])
                for row, value in zip(rows, (np.full(at.sum(), doc_id, np.int64), places[at].astype(np.int64), left[at], right[at], grid[at]), strict=True):
                    row.append(value.tobytes())
        return out


def _turns(places: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose least gram (the first of equals) each anchor is."""
    first, last = np.maximum(places - REACH, 0), np.minimum(places, n - LENGTH)
    for side in (-1, 1):
        open_ = np.ones(len(places), bool)
        for k in range(1, REACH + 1):
            there = np.arange(len(places)) + side * k
            ok = (there >= 0) & (there < len(places))
            there = np.clip(there, 0, max(len(places) - 1, 0))
            ok &= open_ & (np.abs(places[there] - places) <= REACH)
            if not ok.any():
                break
            lower = ok & (hashes[there] <= hashes if side < 0 else hashes[there] < hashes)
            if side < 0:
                first[lower] = np.maximum(first[lower], places[there[lower]] + 1)
            else:
                last[lower] = np.minimum(last[lower], places[there[lower]] - REACH - 1)
            open_ = ok & ~lower
    return first, last


def _runs(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as pairs: the first of a run of neighbours, and the end of its last string."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + 1)))
    return np.stack((starts[new], np.append(starts[new[1:] - 1], starts[-1]) + LENGTH), 1).astype(np.int64)


def _merged_runs(docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows document, first and last start; runs of a document that meet are one. They come sorted by document and first start."""
    if not len(docs):
        return np.empty((3, 0), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (first[1:] > last[:-1] + 1))))
    return np.stack((docs[new], first[new], np.maximum.reduceat(last, new))).astype(np.int64)


def _union(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges of the union of ranges, whose starts are sorted; those that touch are one."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return np.stack((starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]), 1)


SOLVED = "kind string, bucket long, doc_id long, n_bytes long, n_removed long, n_spans long, kept string, payload binary, covered binary"
COLUMNS = ["kind", "bucket", "doc_id", "n_bytes", "n_removed", "n_spans", "kept", "payload", "covered"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], COLUMNS)


def remove(text: bytes, runs: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text without some byte ranges; bytes and runs removed."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    spans = _union(runs[:, 0], runs[:, 1])
    left, at = [], 0
    for a, b in spans.tolist():
        left.append(text[at:a])
        at = b
    left.append(text[at:])
    return b"".join(left), int((spans[:, 1] - spans[:, 0]).sum()), len(spans)


def _result(doc_id: int, text: bytes, runs: np.ndarray, keep_text: bool) -> tuple:
    left, removed, spans = remove(text, runs)
    kept = left.decode("utf-8", "ignore") if keep_text else hashlib.sha256(left).hexdigest()
    return ("done", None, doc_id, len(text), removed, spans, kept, None, None)


@tidied
def _solve(batches: Iterator[pa.RecordBatch], buckets: int, parts: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, packs, text) to finished documents, unfinished ones and pieces for other shards."""
    shard, squeeze = Shard(parts), zstandard.ZstdCompressor(level=3)

    def flush() -> Iterator[pa.RecordBatch]:
        if not shard.docs:
            return
        covered, pieces = shard.solve()
        waiting = {doc for p in pieces.values() for doc in np.frombuffer(b"".join(p[0]), np.int64).tolist()}
        groups, rows = _group(np.array([d[0] for d in shard.docs], np.int64), parts).tolist(), []
        for (doc_id, text, *_), starts, group in zip(shard.docs, covered, groups, strict=True):
            if doc_id in waiting:
                rows.append(("open", group, doc_id, None, None, None, None, squeeze.compress(text), _runs(starts).tobytes()))
            else:
                rows.append(_result(doc_id, text, _runs(starts), keep_text))
        yield _rows(rows)
        for bucket, columns in pieces.items():
            joined = [b"".join(c) for c in columns]
            yield _rows([("piece", bucket, None, len(joined[2]), None, None, None, squeeze.compress(b"".join(joined)), None)])
        shard.__init__(parts)

    for batch in batches:
        for start, stop in slices(batch.column(2), READ):
            texts = as_bytes(batch.column(2)[start:stop])
            owner, places, hashes = _anchors_of(texts)
            bucket, short = _short(hashes, buckets)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            done = []
            for k, (doc_id, packs) in enumerate(zip(batch.column(0)[start:stop].to_pylist(), batch.column(1)[start:stop].to_pylist(), strict=True)):
                at = slice(cuts[k], cuts[k + 1])
                shared = np.concatenate([_unpack(p[8:]) * U64(buckets) + U64(int(np.frombuffer(p[:8], np.int64)[0])) for p in packs])
                hit = np.isin(short[at] * U64(buckets) + bucket[at].astype(U64), shared)
                if hit.any():
                    shard.add(doc_id, texts[k], places[at], hashes[at], hit)
                else:
                    done.append(_result(doc_id, texts[k], np.empty((0, 2), np.int64), keep_text))
            if done:
                yield _rows(done)
            if shard.candidate >= SHARD or shard.held >= HELD:
                yield from flush()
    yield from flush()


# -- across shards ---------------------------------------------------------------------------------


def _gram_names(grid: np.ndarray) -> np.ndarray:
    """A hash of each piece's anchor."""
    out = np.zeros(len(grid), U64)
    for k in range(REACH, REACH + GRAM):
        out *= U64(BASE)
        out += grid[:, k].astype(U64) + U64(1)
    return mix(out)


def merge_pieces(docs: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of every string around these anchors that a smaller document has too.

    Pieces that are alike as a whole are settled first. Of the least document
    of each kind every string takes part: the strings of all shards are merged
    into one order, in which binary search finds each string's equals.
    """
    whole = np.hstack((grid, left[:, None], right[:, None]))
    sums = prefix_sums(whole.ravel())
    width = PIECE + 2
    at = np.arange(len(docs)) * width
    kinds = mix((sums[at + width] - sums[at]) * powers(len(sums))[0][at])
    order = np.lexsort((docs, kinds))
    head = np.concatenate(([True], kinds[order][1:] != kinds[order][:-1]))
    first = order[head][np.cumsum(head) - 1]
    if not (whole[order] == whole[first]).all():  # a collision of 64-bit hashes
        _, kinds = np.unique(np.ascontiguousarray(whole).view(f"V{width}").ravel(), return_inverse=True)
        order = np.lexsort((docs, kinds))
        head = np.concatenate(([True], kinds[order][1:] != kinds[order][:-1]))
        first = order[head][np.cumsum(head) - 1]
    later = order[docs[order] > docs[first]]
    found = [_starts(docs, places, left, right, later)]
    # one piece of each kind, and only where an anchor has several kinds
    kept = order[head]
    _, which, counts = np.unique(_gram_names(grid[kept]), return_inverse=True, return_counts=True)
    kept = kept[counts[which] > 1]
    if len(kept):
        rows = np.ascontiguousarray(grid[kept])
        sums = prefix_sums(rows.ravel())
        column = np.arange(REACH + 1)
        valid = (column[None, :] >= REACH - left[kept][:, None].astype(int)) & (column[None, :] + LENGTH <= REACH + right[kept][:, None].astype(int))
        row, column = np.nonzero(valid)
        at = row * PIECE + column
        keys = mix((sums[at + LENGTH] - sums[at]) * powers(len(sums))[0][at])
        strings = np.lib.stride_tricks.sliding_window_view(rows.ravel(), LENGTH)
        owners = docs[kept][row]
        distinct = np.unique(keys)
        label = np.searchsorted(distinct, keys)
        witness = np.empty(len(distinct), np.int64)
        witness[label] = at
        for k in range(0, len(at), 1 << 18):
            part = slice(k, k + (1 << 18))
            if not (strings[at[part]] == strings[witness[label[part]]]).all():
                _, label = np.unique(np.ascontiguousarray(strings[at]).view(f"V{LENGTH}").ravel(), return_inverse=True)
                break
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, owners)
        # a start is settled for every piece of its kind with the same document, too
        hit = owners > least[label]
        found.append((owners[hit], places[kept][row][hit] + column[hit] - REACH))
        twins = order[~head & (docs[order] == docs[first])]
        if len(twins):
            firsts = first[np.flatnonzero(~head & (docs[order] == docs[first]))]
            by_piece: dict[int, list[int]] = {}
            for piece, offset in zip(kept[row[hit]].tolist(), column[hit].tolist(), strict=True):
                by_piece.setdefault(piece, []).append(offset - REACH)
            extra = [(docs[t], places[t] + o) for t, f in zip(twins.tolist(), firsts.tolist(), strict=True) for o in by_piece.get(f, ())]
            if extra:
                found.append((np.array([e[0] for e in extra]), np.array([e[1] for e in extra])))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _starts(docs: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All strings around the anchors of some pieces."""
    column = np.arange(REACH + 1)
    valid = (column[None, :] >= REACH - left[which][:, None].astype(int)) & (column[None, :] + LENGTH <= REACH + right[which][:, None].astype(int))
    row, column = np.nonzero(valid)
    return docs[which][row], places[which][row] + column - REACH


def _group(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mix(docs.astype(U64)) % U64(groups)).astype(np.int64)


@tidied
def _merge(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """(bucket, size, payload) sorted by bucket to (group of documents, their ids and runs)."""
    now, held, expand = None, [], zstandard.ZstdDecompressor()

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        total, end = sum(n for n, _ in held), 0
        columns = [*(np.empty(total, kind) for kind in (np.int64, np.int64, np.uint8, np.uint8)), np.empty((total, PIECE), np.uint8)]
        for k, (n, raw) in enumerate(held):
            held[k], raw, at = None, expand.decompress(raw), 0
            for column in columns:
                part = column[end : end + n]
                part[:] = np.frombuffer(raw, column.dtype, part.size, at).reshape(part.shape)
                at += part.nbytes
            end += n
        held.clear()
        names = _gram_names(columns[4])
        order = np.argsort(names)
        names = names[order]
        bounds = np.append(np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))), len(names))
        found, a = [], 0
        while a < len(names):
            b = int(bounds[max(np.searchsorted(bounds, a + MERGED, "right") - 1, np.searchsorted(bounds, a, "right"))])
            docs, starts = merge_pieces(*(c[order[a:b]] for c in columns))
            inner = np.lexsort((starts, docs))
            found.append(_merged_runs(docs[inner], starts[inner], starts[inner]))
            a = b
        rows = np.concatenate(found, 1)
        found.clear()
        rows = rows[:, np.lexsort((rows[1], rows[0], _group(rows[0], groups)))]
        rows = _merged_runs(*rows)
        group = _group(rows[0], groups)
        rows[2] += LENGTH
        rows = np.ascontiguousarray(rows.T)
        cuts = np.searchsorted(group, np.arange(groups + 1))
        filled = [g for g in range(groups) if cuts[g] < cuts[g + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([rows[cuts[g] : cuts[g + 1]].tobytes() for g in filled], pa.binary())], ["group", "covered"])

    for batch in batches:
        for bucket, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from flush()
                now = bucket
            held.append((n, raw))
    yield from flush()


@tidied
def _finish(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """(group, doc_id, payload, covered) sorted by these to finished documents; a group's runs come first, without a doc_id."""
    now, found, runs, expand = None, [], {}, zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for group, doc_id, payload, covered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != now:
                now, found, runs = group, [], None
            if payload is None:
                found.append(covered)
                continue
            if runs is None:
                table = np.frombuffer(b"".join(found), np.int64).reshape(-1, 3)
                table = table[np.argsort(table[:, 0], kind="stable")]
                cuts = np.flatnonzero(np.concatenate(([True], table[1:, 0] != table[:-1, 0]))) if len(table) else np.empty(0, np.int64)
                stops = np.append(cuts[1:], len(table))[: len(cuts)]
                runs = {int(table[a, 0]): table[a:b, 1:] for a, b in zip(cuts.tolist(), stops.tolist(), strict=True)}
            own = np.frombuffer(covered, np.int64).reshape(-1, 2)
            more = runs.get(doc_id)
            rows.append(_result(doc_id, expand.decompress(payload), own if more is None else np.concatenate((own, more)), keep_text))
            if len(rows) >= 500:
                yield _rows(rows)
                rows = []
        yield _rows(rows)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every row of ``docs`` (doc_id, text).

    Every byte of a text's UTF-8 form goes that a string of LENGTH bytes
    covers which also starts in a document with a smaller id; all strings are
    judged on the input. ``kept`` is the SHA-256 of the bytes left or, with
    ``keep_text``, the text left (bytes of a character that was cut go too;
    null where the text has nothing in common with others, so nothing went).

    1. Anchors: the least gram of every string, packed by hash bucket, tells
       which grams occur in several different texts; the rest can't repeat.
    2. Shards: the text around shared anchors of some megabytes of documents
       is sorted into a suffix array; its common prefixes give the strings
       that a smaller document of the shard has.
    3. Merging: of strings without such a document, pieces go to the bucket of
       their anchor, where the strings of all shards are merged and looked up
       by binary search.

    Whole copies are settled by hash beforehand. A passage that a third of the
    documents share leaves each shard once, so no task meets all of them.
    Null and empty texts, and those shorter than a string, stay; rows that
    share an id don't remove from each other; rows without an id are left
    alone. A very long text is a shard of its own. All partitions are counted
    by bytes, so a task's share hardly grows with the input. No rows give no
    rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    cid = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("cid")
    kept = ["doc_id", "sha", cid, F.octet_length("text").cast("long").alias("n_bytes")]
    ids = cut(named.select(*kept))
    parts = partitions_for(spark, ids.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets = max(4, parts // 2)
    copies = cut(ids.groupBy("sha").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper"))
    ids = ids.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.expr(f"n_bytes >= {LENGTH} and doc_id > keeper"), F.lit(False)))

    offered = named.select(cid, "text").mapInArrow(partial(_offer, buckets=buckets), "bucket long, cids binary, counts binary, hashes binary")
    answers = offered.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "cid long, pack binary")
    packs = answers.groupBy("cid").agg(F.collect_list("pack").alias("packs"))
    live = cut(ids.where("not copy and doc_id is not null").join(packs, "cid", "left").select("doc_id", "sha", "n_bytes", "packs"))
    del offered, answers, packs
    asked = live.where("packs is not null").select("doc_id", "sha", "packs").dropDuplicates(["doc_id", "sha"])
    placed = named.repartition(parts, "doc_id", "sha").join(asked.repartition(parts, "doc_id", "sha"), ["doc_id", "sha"])
    solved = cut(placed.select("doc_id", "packs", "text").mapInArrow(partial(_solve, buckets=buckets, parts=parts, keep_text=keep_text), SOLVED))
    pieces = solved.where("kind = 'piece'").select("bucket", "n_bytes", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")
    merged = pieces.mapInArrow(partial(_merge, groups=parts), "group long, covered binary")
    none = F.lit(None)
    unfinished = solved.where("kind = 'open'").select(F.col("bucket").alias("group"), "doc_id", "payload", "covered")
    unfinished = unfinished.union(merged.select("group", none.cast("long"), none.cast("binary"), "covered"))
    finished = unfinished.repartition(parts, "group").sortWithinPartitions("group", F.col("doc_id").asc_nulls_first()).mapInArrow(partial(_finish, keep_text=keep_text), SOLVED)
    result = solved.where("kind = 'done'").union(finished).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    zero = F.lit(0).cast("long")
    gone = ids.where("copy").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("" if keep_text else EMPTY).alias("kept"))
    quiet = live.where("packs is null").select("doc_id", "sha", "n_bytes").union(ids.where("doc_id is null").select("doc_id", "sha", "n_bytes"))
    unchanged = F.lit(None).cast("string") if keep_text else F.col("sha")
    return result.union(gone).union(quiet.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), unchanged.alias("kept")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that ``remove_repeats`` leaves (pipeline form; rows that share an id should be gone)."""
    changed = remove_repeats(docs, keep_text=True).where("n_removed > 0").select(F.col("doc_id").alias("changed_id"), F.coalesce("kept", F.lit("")).alias("left_text")).dropDuplicates(["changed_id"])
    joined = docs.join(changed, docs["doc_id"] == F.col("changed_id"), "left")
    text = F.when(F.col("changed_id").isNull(), docs["text"]).otherwise(F.col("left_text"))
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("kept", "kept_sha256")
