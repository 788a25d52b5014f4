"""MinHash near-duplicate detection, exact on what it links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, Hashes, as_bytes, cut, mix, numbered, partitions_for, slices, tidied, window_hashes
from .graph import connected_components

WIDTH = 5
#: 40 bands of 6 minima: two texts at similarity 0.85 share no band with probability 6e-9, at 0.8 with 5e-6.
BANDS, ROWS = 40, 6
#: Shingles of a verification block; a task holds two blocks at a time.
BLOCK = 1 << 16

_random = np.random.default_rng(20240501)
MULTIPLIERS = (_random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADDENDS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
BAND_SALT = mix(np.arange(1, BANDS + 2, dtype=U64))


def shingle_sets(texts: list[bytes], known: Hashes | None = None) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, made of the hashes of their words (``known``: of words met before)."""
    hashes, first = numbered([t.lower() for t in texts], Hashes() if known is None else known)  # of bytes: A-Z only
    windows = window_hashes(hashes, WIDTH)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(windows[a : b - WIDTH + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.empty(0, U64))
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band from the minima of universal hashes, and one of the whole set."""
    low = (shingles >> U64(32)).astype(np.uint32)
    minima = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(minima, (low[k : k + 256, None] * MULTIPLIERS + ADDENDS).min(0), out=minima)
    rows = minima.reshape(BANDS, ROWS).astype(U64)
    keys = np.zeros(BANDS + 1, U64)
    for r in range(ROWS):
        keys[:BANDS] = keys[:BANDS] * U64(BASE) + rows[:, r]
    keys[BANDS] = U64(int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little"))
    return mix(keys ^ BAND_SALT)


SKETCH = "doc_id long, n_shingles long, same_as long, keys binary"


@tidied
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document; of documents with equal sets in a task only the first by id has keys."""
    ids, sizes, sets, least, keys, known = [], [], [], {}, {}, Hashes()
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            for doc_id, shingles in zip(batch.column(0)[start:stop].to_pylist(), shingle_sets(as_bytes(batch.column(1)[start:stop]), known), strict=True):
                ids.append(doc_id)
                sizes.append(len(shingles))
                name = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) and doc_id is not None else None
                sets.append(name)
                if name is not None:
                    if name not in least:
                        keys[name] = band_keys(shingles).tobytes()
                    least[name] = min(doc_id, least.get(name, doc_id))
    same = [i if s is None else least[s] for i, s in zip(ids, sets, strict=True)]
    first = [keys.pop(s, None) if s is not None and i == j else None for i, j, s in zip(ids, same, sets, strict=True)]
    for k in range(0, len(ids), 20_000):
        part = slice(k, k + 20_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[part], pa.int64()), pa.array(sizes[part], pa.int64()), pa.array(same[part], pa.int64()), pa.array(first[part], pa.binary())], ["doc_id", "n_shingles", "same_as", "keys"]
        )


@tidied
def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs (key, id) by key; ids that share a key within the task are linked here and go on as their least."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), U64)
        order = np.lexsort((np.repeat(ids, BANDS + 1), keys))
        keys, owners = keys[order], np.repeat(ids, BANDS + 1)[order]
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = owners[head][np.cumsum(head) - 1]
        yield _edges(owners, first, 0)
        keys, owners = keys[head], owners[head]
        bucket = (keys % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        names = [int(bucket[p[0]]) for p in np.split(order, cuts)]
        yield _packed(names, [keys[p].tobytes() for p in np.split(order, cuts)], [owners[p].tobytes() for p in np.split(order, cuts)])


def _packed(buckets: list[int], keys: list[bytes], owners: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(keys, pa.binary()), pa.array(owners, pa.binary())], ["bucket", "keys", "owners"])


def _edges(owners: np.ndarray, first: np.ndarray, tag: int) -> pa.RecordBatch:
    """Links as one packed row of bucket -1 (none: no row)."""
    pairs = np.unique(np.stack((owners, first), 1)[owners != first], axis=0)
    if not len(pairs):
        return _packed([], [], [])
    return _packed([-1 - tag], [pairs[:, 0].tobytes()], [pairs[:, 1].tobytes()])


@tidied
def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links the owners of equal keys, bucket by bucket (rows come sorted by bucket)."""
    now, keys, owners = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if keys:
            k, o = np.frombuffer(b"".join(keys), U64), np.frombuffer(b"".join(owners), np.int64)
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            head = np.concatenate(([True], k[1:] != k[:-1]))
            yield _edges(o, o[head][np.cumsum(head) - 1], 1)

    for batch in batches:
        for bucket, k, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from flush()
                now, keys, owners = bucket, [], []
            keys.append(k)
            owners.append(o)
    yield from flush()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.int64) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


@tidied
def _attach_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, set)."""
    known = Hashes()
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            sets = [s.tobytes() for s in shingle_sets(as_bytes(batch.column(1)[start:stop]), known)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def links_of(ids: list[int], sets: list[np.ndarray], percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Star edges of the components among documents whose sets meet the threshold, by exact intersections.

    Documents of one of the ``groups`` are known to be connected and are not compared.
    """
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, ends = np.concatenate(sets), np.cumsum(lengths)
    distinct, flat = np.unique(flat, return_inverse=True)
    root = np.arange(len(ids)) if groups is None else np.unique(groups, return_index=True)[1][np.unique(groups, return_inverse=True)[1]]
    mark = np.zeros(len(distinct), bool)
    for i in range(len(ids) - 1):
        if (root == root[0]).all():
            break
        if (root[i + 1 :] == root[i]).all():
            continue
        own = flat[ends[i] - lengths[i] : ends[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat[ends[i] :]], ends[i:-1] - ends[i], dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(100 * shared >= percent * (lengths[i] + lengths[i + 1 :] - shared)) + i + 1
        if len(near):
            meet = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, meet)] = meet[0]
    names = np.array(ids, np.int64)
    out = []
    for r in np.unique(root):
        members = names[root == r]
        out += [(int(m), int(members.min())) for m in members[members != members.min()]]
    return out


def links_to(leader: int, own: np.ndarray, ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(document, leader) for the documents whose sets meet the threshold with the leader's, by exact intersections."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    shared = np.add.reduceat(own[place] == flat, np.cumsum(lengths) - lengths, dtype=np.int64)
    near = 100 * shared >= percent * (lengths + len(own) - shared)
    return [(d, leader) for d, hit in zip(ids, near.tolist(), strict=True) if hit]


@tidied
def _verify(batches: Iterator[pa.RecordBatch], percent: int, stars: bool) -> Iterator[pa.RecordBatch]:
    """Rows (block, first, doc_id, group, shingles) come sorted by block; of ``stars`` the leader comes first and meets the others only."""
    now, ids, groups, sets, leaders = None, [], [], [], 0
    edges: list[tuple[int, int]] = []

    def close() -> None:
        if len(ids) > 1 and not stars:
            edges.extend(links_of(ids, sets, percent, groups))
        elif len(ids) > leaders:
            for k in range(leaders):  # several rows may share the leader's id
                edges.extend(links_to(ids[k], sets[k], ids[leaders:], sets[leaders:], percent))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])
        edges.clear()
        return batch

    for batch in batches:
        for block, place, doc_id, group, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                close()
                now, ids, groups, sets, leaders = block, [], [], [], 0
            leaders += place == 0
            ids.append(doc_id)
            groups.append(group)
            sets.append(np.frombuffer(shingles, U64))
        if edges:
            yield out()
    close()
    yield out()


def _star_blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """block, first, doc_id, group: each leader of a star with the documents of it, in parts of about BLOCK shingles."""
    load = pairs.join(sizes, F.col("u") == F.col("doc_id")).groupBy("v").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    members = pairs.join(load, "v").select(F.concat_ws(".", "v", part).alias("block"), F.lit(1).alias("first"), F.col("u").alias("doc_id"))
    leaders = load.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.concat_ws(".", "v", "part").alias("block"), F.lit(0).alias("first"), F.col("v").alias("doc_id"))
    return members.union(leaders).withColumn("group", F.lit(0).cast("long"))


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """doc_id and ``blocks``, the names of the verification blocks in which a document takes part.

    A small cluster is one block. A large one is split by size class (sets of
    which one is over 100/percent times the other can't be linked, so a class
    meets itself and its neighbours only) and, within a class, by hash of the
    id into parts of BLOCK shingles; every two parts of a class, and of
    neighbouring classes, meet in one block.
    """
    sizes = members.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    sized = cut(members.join(sizes, "component"))
    small = sized.where(F.col("total") <= 2 * BLOCK).select("doc_id", F.array(F.col("component").cast("string")).alias("blocks"))
    size_class = F.floor(F.log("n_shingles") / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    large = sized.where(F.col("total") > 2 * BLOCK).withColumn("class", size_class)
    parts = large.groupBy("component", "class").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("parts"))
    parts = cut(parts)
    above = parts.select("component", (F.col("class") - 1).alias("class"), F.col("parts").alias("above"))
    below = parts.select("component", (F.col("class") + 1).alias("class"), F.col("parts").alias("below"))
    table = parts.join(above, ["component", "class"], "left").join(below, ["component", "class"], "left").na.fill(0)
    placed = large.join(table, ["component", "class"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    names = F.expr("""
        concat(
          transform(sequence(0, parts - 1), i -> concat_ws('.', component, class, least(part, i), class, greatest(part, i))),
          if(above > 0, transform(sequence(0, above - 1), i -> concat_ws('.', component, class, part, class + 1, i)), array()),
          if(below > 0, transform(sequence(0, below - 1), i -> concat_ws('.', component, class - 1, i, class, part)), array()))
    """)
    return small.union(placed.select("doc_id", names.alias("blocks")))


def _unsettled(members: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, component, n_shingles, group: the members of clusters in which a link may be left to find.

    Nothing is left where the stars' links connect a whole cluster, or where every two of its documents met in a star.
    """
    grouped = members.join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", members["component"], "n_shingles", F.coalesce("found", "doc_id").alias("group"))
    met = pairs.join(members, F.col("u") == F.col("doc_id")).groupBy("component").agg(F.count("*").alias("met"))
    # equal counts of distinct groups tell a settled cluster: the least and the largest group are one
    open_ = grouped.groupBy("component").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    open_ = open_.join(met, "component").where("2 * met < n * (n - 1)").select("component")
    return grouped.join(open_, "component")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Documents are linked where 100 * |A & B| >= percent * |A | B| for their sets
    of five-word shingles. Banding proposes: documents that share a band are
    tied in a star, and stars join into candidate clusters by alternating
    large-star and small-star. Verification disposes on the full sets: first
    each star's documents against its leader, which is linear in the cluster
    and connects most of it; then, in clusters that this leaves in several
    groups whose documents have not all met, every two documents of different
    groups, in blocks of bounded size. The links that hold give the components,
    again by large-star and small-star.

    Equal sets are merged within each task before any shuffle, and a band that
    many documents share goes on from each task as one id, so neither large
    groups of copies nor very common bands meet in one task.

    Texts without words (null or empty too) and rows without an id have no
    links. Rows that share an id are one document. Ties go to the smaller id.
    Long texts are whole sets; a worker holds one such text, its words' hashes
    and those of its shingles (8 bytes each). No rows give no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut(rows.mapInArrow(_sketch, SKETCH))
    total = sketches.agg(F.coalesce(F.count("keys"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("keys").isNotNull(), F.col("n_shingles"))), F.lit(0))).first()
    n = partitions_for(spark, 16 * (BANDS + 1) * total[0])
    packed = "bucket long, keys binary, owners binary"
    dealt = cut(sketches.where("keys is not null").select("doc_id", "keys").mapInArrow(partial(_deal, buckets=n), packed))
    linked = dealt.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_link, packed)
    edges = dealt.where("bucket < 0").union(linked).mapInArrow(_unpack, "u long, v long")
    pairs = cut(edges.selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    clusters = connected_components(pairs)
    sizes = sketches.where("keys is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    members = cut(clusters.join(sizes, F.col("node") == F.col("doc_id")).select("doc_id", "component", "n_shingles"))
    tasks = partitions_for(spark, 8 * total[1])
    wanted = rows.where("doc_id is not null").join(members.select("doc_id"), "doc_id").select("doc_id", "text")
    sets = cut(wanted.mapInArrow(_attach_sets, "doc_id long, shingles binary"))

    def verified(blocks: DataFrame, stars: bool) -> DataFrame:
        held = blocks.join(sets, "doc_id").select("block", "first", "doc_id", "group", "shingles").repartition(tasks, "block").sortWithinPartitions("block", "first", "doc_id")
        return held.mapInArrow(partial(_verify, percent=percent, stars=stars), "u long, v long")

    components = connected_components(verified(_star_blocks(pairs, sizes), True))
    left = cut(_unsettled(members, pairs, components.select("node", F.col("component").alias("found"))))
    if not left.isEmpty():
        blocks = left.select("doc_id", "group").join(_blocks(left.drop("group"), percent), "doc_id").select("doc_id", "group", F.explode("blocks").alias("block"), F.lit(0).alias("first"))
        known = components.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        components = connected_components(known.union(verified(blocks, False)))
    out = sketches.select("doc_id", "n_shingles", "same_as").join(components, F.col("same_as") == F.col("node"), "left")
    component = F.coalesce("component", "same_as")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)
), r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v
), c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
