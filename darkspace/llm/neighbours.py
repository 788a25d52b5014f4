"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, erf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Cells of a projection, the outer ones without end, and their width in standard deviations.
CELLS, WIDTH = 3, 0.86
#: Vectors that a bucket and a slot (the buckets of a task) have on average; a slot of SPLIT times as many is split.
BUCKET, SLOT, SPLIT = 8, 8192, 4
#: Projections of a table at most, and those that name its slots: 3**9 slots a table bound what is broadcast.
MOST, MOST_SLOTS = 16, 9
#: Vectors on which the probes are fitted, and the recall asked for there.
SAMPLE, RECALL = 256, 0.94
#: Queries that are answered at a time, and distinct vectors that a task holds while it looks for equal ones.
TOGETHER, HELD = 256, 50_000


# -- hashing -----------------------------------------------------------------------------------------


@dataclass
class Index:
    """Projections and offsets of every table, the cosine of neighbours, and the success down to which buckets are visited."""

    planes: np.ndarray  # table, dimension, projection
    offsets: np.ndarray  # table, projection
    slot_dims: int
    near: float = 1.0
    level: float = -np.inf
    salts: np.ndarray | None = None  # of every table and slot

    @classmethod
    def draw(cls, n: int, dimension: int, seed: int = 7) -> Index:
        """Projections for ``n`` vectors: their number, and that of tables, grows with log n."""
        count = int(np.clip(round(log(max(n / BUCKET, 1), CELLS)), 1, MOST))
        slot_dims = int(np.clip(round(log(max(n / SLOT, 1), CELLS)), 0, min(count, MOST_SLOTS)))
        tables = 2 + count // 8
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((tables, dimension, count)), rng.uniform(-0.2, 0.2, (tables, count)), slot_dims)

    @property
    def tables(self) -> int:
        return self.planes.shape[0]

    @property
    def slots(self) -> int:
        return CELLS**self.slot_dims

    @property
    def slot_buckets(self) -> int:
        """Buckets of a slot."""
        return CELLS ** (self.planes.shape[2] - self.slot_dims)

    def buckets(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot and bucket within it of each vector: floor((a x + b) / w) of every projection, with open outer cells."""
        places = directions(x) @ self.planes[table] + self.offsets[table]
        cells = np.clip(np.floor(places / WIDTH + CELLS / 2), 0, CELLS - 1).astype(np.int64)
        powers = CELLS ** np.arange(cells.shape[1])
        slot = (cells[:, : self.slot_dims] * powers[: self.slot_dims]).sum(1)
        return slot, (cells[:, self.slot_dims :] * powers[: cells.shape[1] - self.slot_dims]).sum(1)

    def chances(self, x: np.ndarray, table: int) -> np.ndarray:
        """query x projection x cell: log of the chance that a neighbour lies in the cell.

        A neighbour at cosine r has projections that are normal about r times
        the query's, with variance 1 - r * r.
        """
        places = self.near * (directions(x) @ self.planes[table]) + self.offsets[table]
        edges = (np.arange(1, CELLS) - CELLS / 2) * WIDTH
        below = _normal((edges - places[:, :, None]) / np.sqrt(max(1 - self.near**2, 1e-4)))
        cells = np.diff(np.concatenate((np.zeros((*places.shape, 1)), below, np.ones((*places.shape, 1))), 2), axis=2)
        return np.log(np.maximum(cells, 1e-12))

    def slot_success(self, chances: np.ndarray) -> np.ndarray:
        """query x slot: log success of the slot's best bucket."""
        return _sums(chances[:, : self.slot_dims]) + chances[:, self.slot_dims :].max(2).sum(1)[:, None]

    def success(self, chances: np.ndarray, slot: int) -> np.ndarray:
        """query x bucket of a slot: log of the estimated success, whose order buckets are visited in."""
        own = [slot // CELLS**k % CELLS for k in range(self.slot_dims)]
        outer = sum((chances[:, k, c] for k, c in enumerate(own)), np.zeros(len(chances)))
        return _sums(chances[:, self.slot_dims :]) + outer[:, None]

    def success_at(self, chances: np.ndarray, slot: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Log success of one bucket a query."""
        out, rows = np.zeros(len(chances)), np.arange(len(chances))
        for k in range(chances.shape[1]):
            cell = slot // CELLS**k if k < self.slot_dims else local // CELLS ** (k - self.slot_dims)
            out += chances[rows, k, cell % CELLS]
        return out


def directions(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, without overflow for any finite components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_GRID = np.linspace(-8, 8, 8001)
_TABLE = np.array([0.5 * (1 + erf(z / 2**0.5)) for z in _GRID])


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution, by interpolation."""
    return np.interp(z, _GRID, _TABLE)


def _sums(chances: np.ndarray) -> np.ndarray:
    """Sums over all combinations of cells, the first projection's cell running fastest."""
    out = np.zeros((len(chances), 1))
    for k in range(chances.shape[1]):
        out = (chances[:, k, :, None] + out[:, None, :]).reshape(len(chances), -1)
    return out


# -- vectors -----------------------------------------------------------------------------------------

ENTRY = "key binary, vector binary, ids array<long>, queries array<long>"


def _matrix(column: pa.Array, single: bool) -> np.ndarray:
    """Vectors of one length, as doubles."""
    kind = np.float32 if single else np.float64
    if not len(column):
        return np.empty((0, 0))
    size = len(column[0].as_py()) // kind().itemsize
    first = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, len(column) * size, int(first)).reshape(len(column), size).astype(np.float64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _entries(batches: Iterator[pa.RecordBatch], dimension: int, single: bool, keep: int, every: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to a row for each distinct vector of a task: its smallest ids and its query ids."""
    kind = np.float32 if single else np.float64
    found: dict[bytes, tuple[list, list]] = {}

    def out() -> pa.RecordBatch:
        vectors = list(found)
        keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vectors]
        ids, queries = [sorted(set(i))[:keep] for i, _ in found.values()], [q for _, q in found.values()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(queries, pa.list_(pa.int64()))], ["key", "vector", "ids", "queries"])

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(1).flatten()
        x = values.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dimension) + kind(0)  # null components are NaN here
        good = np.isfinite(x).all(1) & x.any(1)
        raw = x.view(f"V{x.itemsize * dimension}").ravel()
        for k in np.flatnonzero(good).tolist():
            vec_id = batch.column(0)[k].as_py()
            ids, queries = found.setdefault(raw[k].tobytes(), ([], []))
            ids.append(vec_id)
            if len(ids) > 4 * keep:
                ids[:] = sorted(set(ids))[:keep]
            if vec_id % every == 0:
                queries.append(vec_id)
        while len(found) >= HELD:
            yield out()
    if found:
        yield out()


# -- fitting -----------------------------------------------------------------------------------------

NEAR = "q long, vector binary, score double"


def _nearest_of(batches: Iterator[pa.RecordBatch], sample: list[bytes], single: bool, most: int) -> Iterator[pa.RecordBatch]:
    """The task's vectors of the largest products with each sample vector, other than itself."""
    queries = _matrix(pa.array(sample, pa.binary()), single)
    scores, vectors = np.empty((len(sample), 0)), np.empty(0, object)
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            column = batch.column(0).slice(start, 4096)
            fresh = np.nan_to_num(queries @ _matrix(column, single).T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            own = np.array(column.to_pylist(), object)
            scores, vectors = np.hstack((scores, fresh)), np.append(vectors, own)
            if scores.shape[1] > most + 1:
                kept = np.unique(np.argpartition(-scores, most, axis=1)[:, : most + 1])
                scores, vectors = scores[:, kept], vectors[kept]
    rows = [(q, vectors[p], float(row[p])) for q, row in enumerate(scores) for p in np.argsort(-row)[: most + 1].tolist() if vectors[p] != sample[q]]
    for k in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), (pa.int64(), pa.binary(), pa.float64()), strict=True)], ["q", "vector", "score"])


def fit(entries: DataFrame, index: Index, single: bool, most: int, sample: int, recall: float) -> None:
    """Sets the cosine of neighbours and the level of success, on ``sample`` vectors against all.

    The level is the one at which so large a share of the true neighbours (by
    inner product) lies in a visited bucket of some table.
    """
    chosen = [bytes(r[0]) for r in entries.select("vector", "key").orderBy("key").limit(sample).select("vector").distinct().collect()]
    if not chosen:
        return
    near = entries.select("vector").mapInArrow(partial(_nearest_of, sample=chosen, single=single, most=most), NEAR).distinct()
    ranked = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vector")), asc=False), 1, most).alias("best"))
    pairs = [(r.q, bytes(b.vector)) for r in ranked.collect() for b in r.best]
    if not pairs:
        return
    queries = _matrix(pa.array(chosen, pa.binary()), single)
    owner, found = np.array([q for q, _ in pairs]), _matrix(pa.array([v for _, v in pairs], pa.binary()), single)
    index.near = float(np.clip(np.mean((directions(queries)[owner] * directions(found)).sum(1)), -0.99, 0.99))
    needed = np.full(len(pairs), -np.inf)
    for table in range(index.tables):
        needed = np.maximum(needed, index.success_at(index.chances(queries, table)[owner], *index.buckets(found, table)))
    index.level = float(np.quantile(needed, 1 - recall) - 1e-9)


def _counts(batches: Iterator[pa.RecordBatch], index: Index, single: bool) -> Iterator[pa.RecordBatch]:
    """Vectors of each table and slot."""
    total = np.zeros(index.tables * index.slots, np.int64)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0), single)
            for table in range(index.tables):
                total += np.bincount(index.buckets(x, table)[0] + table * index.slots, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


# -- searching ---------------------------------------------------------------------------------------

VECTOR, QUERY, EVERYWHERE = range(3)
DEALT = "slot long, salt int, kind int, key binary, vector binary, ids array<long>"
FOUND = "key binary, ids array<long>, scores array<double>"


def _take(batch: pa.RecordBatch, slot: np.ndarray, salt: np.ndarray, kind: int, rows: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(rows)
    n = len(rows)
    ids = batch.column(2).take(rows) if kind == VECTOR else pa.nulls(n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(slot, pa.int64()), pa.array(salt, pa.int32()), pa.array(np.full(n, kind), pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows), ids], ["slot", "salt", "kind", "key", "vector", "ids"]
    )


def _deal(batches: Iterator[pa.RecordBatch], index: Index, single: bool, first: int = 0) -> Iterator[pa.RecordBatch]:
    """A row for each vector and table, at its slot, and for each query and slot in which it visits a bucket."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            x, rows = _matrix(batch.column(1), single), np.arange(batch.num_rows)
            least = np.array([i[0] for i in batch.column(2).to_pylist()])
            for table in range(index.tables):
                slot = index.buckets(x, table)[0] + table * index.slots
                yield _take(batch, slot, least % index.salts[slot], VECTOR, rows)
            asking = np.flatnonzero(batch.column(3).value_lengths().to_numpy())
            for k in range(0, len(asking), TOGETHER):
                part = asking[k : k + TOGETHER]
                for table in range(index.tables):
                    who, slot = np.nonzero(index.slot_success(index.chances(x[part], table)) >= index.level)
                    yield from _ask(batch, part[who], slot + table * index.slots, index, QUERY)


def _ask(batch: pa.RecordBatch, rows: np.ndarray, slots: np.ndarray, index: Index, kind: int) -> Iterator[pa.RecordBatch]:
    """Queries at slots, once for each part of a slot that is split."""
    parts = index.salts[slots]
    salt = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    rows, slots = np.repeat(rows, parts), np.repeat(slots, parts)
    for k in range(0, len(rows), 8192):
        yield _take(batch, slots[k : k + 8192], salt[k : k + 8192], kind, rows[k : k + 8192])


def _ask_all(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Each query at every slot of the first table."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _ask(batch, np.full(index.slots, k), np.arange(index.slots), index, EVERYWHERE)


class _Slot:
    """The vectors of a slot, sorted by bucket, and the answers to its queries."""

    def __init__(self, index: Index, single: bool, keep: int):
        self.index, self.single, self.keep = index, single, keep
        self.slot, self.parts = -1, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def _build(self) -> None:
        rows = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        x = _matrix(rows.column("vector"), self.single)
        local = self.index.buckets(x, self.slot // self.index.slots)[1]
        order = np.argsort(local, kind="stable")
        self.x, ids = x[order], rows.column("ids").take(pa.array(order))
        self.begin = np.searchsorted(local[order], np.arange(self.index.slot_buckets + 1))
        self.ids, self.lengths = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.parts = []

    def answer(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._build()
        elif self.x is None:
            return
        for start in range(0, rows.num_rows, TOGETHER):
            part = rows.slice(start, TOGETHER)
            yield self._answer(part.column("key"), _matrix(part.column("vector"), self.single), part.column("kind").to_numpy())

    def _answer(self, keys: pa.Array, q: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        table, slot = divmod(self.slot, self.index.slots)
        visits = (self.index.success(self.index.chances(q, table), slot) >= self.index.level) | (kind == EVERYWHERE)[:, None]
        scores = np.full((len(q), len(self.x)), -np.inf)
        for b in np.flatnonzero(np.diff(self.begin)).tolist():
            who = np.flatnonzero(visits[:, b])
            if len(who):
                a, z = self.begin[b], self.begin[b + 1]
                scores[who, a:z] = q[who] @ self.x[a:z].T
        scores[np.isnan(scores)] = -np.inf
        rows, at, values = largest(scores, self.keep)
        counts = self.lengths[at]
        which = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        per_query = np.bincount(rows, weights=counts, minlength=len(q)).astype(np.int64)
        return pa.RecordBatch.from_arrays([keys, _lists(self.ids[which], per_query, pa.int64()), _lists(np.repeat(values, counts), per_query, pa.float64())], ["key", "ids", "scores"])


def largest(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the ``keep`` largest of each row and all that equal the last of them, -inf excepted."""
    if scores.shape[1] > keep:
        least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        hit = (scores >= least[:, None]) & (scores > -np.inf)
    else:
        hit = scores > -np.inf
    rows, at = np.nonzero(hit)
    return rows, at, scores[rows, at]


def _search(batches: Iterator[pa.RecordBatch], index: Index, single: bool, keep: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, salt, kind): the vectors of a slot's part, then the queries that visit it."""
    now, held = None, _Slot(index, single, keep)
    for batch in batches:
        slot, salt, kind = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((np.diff(slot) != 0) | (np.diff(salt) != 0) | (np.diff(np.minimum(kind, QUERY)) != 0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if a == z:
                continue
            if (slot[a], salt[a]) != now:
                now, held = (slot[a], salt[a]), _Slot(index, single, keep)
                held.slot, held.x = int(slot[a]), None
            if kind[a] == VECTOR:
                held.add(batch.slice(a, z - a))
            else:
                yield from held.answer(batch.slice(a, z - a))


def _merge(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by query: the union of what its buckets in all tables gave, the best first."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("key").combine_chunks()
        raw = keys.to_pylist()
        new = np.array([True, *(a != b for a, b in zip(raw[1:], raw[:-1], strict=True))])
        lists = rows.column("ids").combine_chunks()
        group = np.repeat(np.cumsum(new) - 1, lists.value_lengths().to_numpy())
        ids, scores = lists.flatten().to_numpy(), rows.column("scores").combine_chunks().flatten().to_numpy()
        order = np.lexsort((-scores, ids, group))
        group, ids, scores = group[order], ids[order], scores[order]
        fresh = np.ones(len(ids), bool)  # tables may differ in the last bit of a product, so an id counts, not the pair
        fresh[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
        group, ids, scores = group[fresh], ids[fresh], scores[fresh]
        order = np.lexsort((ids, -scores, group))
        group, ids, scores = group[order], ids[order], scores[order]
        sizes = np.bincount(group, minlength=int(new.sum()))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best = place < keep
        counts = np.minimum(sizes, keep)
        return pa.RecordBatch.from_arrays([keys.filter(pa.array(new)), _lists(ids[best], counts, pa.int64()), _lists(scores[best], counts, pa.float64())], ["key", "ids", "scores"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[batch.num_rows - 1].as_py()
        keys = batch.column(0).to_pylist()
        own = next((k for k in range(len(keys) - 1, -1, -1) if keys[k] != last), -1) + 1  # where the last query's rows begin
        if own or held and held[-1].column(0)[0].as_py() != last:
            ready = [*held, batch.slice(0, own)]
            held = []
            yield out(pa.Table.from_batches(ready))
        held.append(batch.slice(own))
        if len(held) > 8:
            held = [out(pa.Table.from_batches(held))]
    if held:
        yield out(pa.Table.from_batches(held))


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, most: int = 20, every: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every`` its ``most`` nearest other rows.

    ``vectors`` has vec_id and embedding. Nearest is the largest inner product
    in double precision, ties to the smaller id. Every table hashes a vector's
    direction by p-stable projections; a query visits the buckets of each
    table in order of estimated success down to a level at which, on a sample
    of ``sample`` vectors against all, ``recall`` of the true neighbours were
    reached. What the tables give is merged by exact product. A query for
    which they give fewer than ``most`` rows is compared with all.

    Rows without an id, and vectors that are null, empty, zero, or hold null or
    non-finite components, take no part; nor do vectors of another length than
    the commonest (of equally common ones the largest), which have no product
    with the others. Products that overflow to minus infinity or to no number
    aren't listed. Equal vectors of a task are one entry with their smallest
    ids, and equal queries are asked once, so a vector that a third of the
    rows share costs no more than another; of rows that share an id the one
    with the least vector counts. A slot with many more vectors than others is split. No rows give no
    rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    keep = most + 1  # a query's own row is among them
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    typed = typed.where("vec_id is not null and size(embedding) > 0")
    length = typed.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is None:
        return spark.createDataFrame([], RESULT)
    dimension, n = length[0], length[1]
    typed = typed.where(F.size("embedding") == dimension)
    again = cut(typed.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if not again.isEmpty():
        finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
        once = typed.join(again, "vec_id", "left_semi").where(finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        typed = typed.join(again, "vec_id", "left_anti").union(once)
    entries = typed.mapInArrow(partial(_entries, dimension=dimension, single=single, keep=keep, every=every), ENTRY)
    index = Index.draw(n, dimension)
    fit(entries, index, single, most, sample, recall)
    counts = entries.select("vector").mapInArrow(partial(_counts, index=index, single=single), "slot long, n long").groupBy("slot").sum("n").collect()
    index.salts = np.ones(index.tables * index.slots, np.int64)
    for slot, held in counts:
        index.salts[slot] = ceil(held / (SPLIT * SLOT))
    tasks = max(shuffle_partitions(spark), int(index.salts.sum()))
    dealt = entries.mapInArrow(partial(_deal, index=index, single=single), DEALT)

    def searched(rows: DataFrame) -> DataFrame:
        found = rows.repartition(tasks, "slot", "salt").sortWithinPartitions("slot", "salt", "kind").mapInArrow(partial(_search, index=index, single=single, keep=keep), FOUND)
        return found.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(partial(_merge, keep=keep), FOUND)

    found = cut(searched(dealt))
    asked = entries.where("size(queries) > 0")
    enough = found.where(F.size("ids") >= keep).select("key", "ids", "scores")
    short = cut(asked.select("key", "vector").join(enough.select("key"), "key", "left_anti").dropDuplicates(["key"]))
    if not short.isEmpty():
        everything = short.select("key", "vector").mapInArrow(partial(_ask_all, index=index), DEALT)
        enough = enough.union(searched(dealt.where(f"kind = {VECTOR} and slot < {index.slots}").union(everything)))
    queries = asked.select("key", F.explode("queries").alias("query_id")).distinct()
    rows = queries.join(enough, "key")
    pairs = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda p: p["ids"] != F.col("query_id")), 1, most)
    return rows.select("query_id", F.posexplode(pairs).alias("place", "pair")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("pair.ids").alias("vec_id"), F.col("pair.scores").alias("score"))


def op4_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
