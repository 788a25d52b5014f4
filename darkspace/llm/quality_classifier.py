"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, shuffle_partitions, slices, tidied
from .quality_rules import measure

#: Trusted positives at most; of the unlabelled all are used.
SAMPLE = 20_000
#: Penalty of the weights, a spread below which features hardly count, and how steeply the score follows the decision.
RIDGE, FLAT, SHARP = 0.1, 0.02, 4.0
#: Bins of the density ratio for the prior's estimate.
BINS, LOW, HIGH = 600, -1.0, 4.0
SHAPES = 9


def features(texts: list[bytes]) -> np.ndarray:
    """Shape measurements (how much of a text is symbols, capitals, repeats, ...) and byte frequencies of whole texts."""
    m = {k: v.astype(float) for k, v in measure(texts).items()}
    words, lines, letters = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["n_letters"], 1)
    shares = [m["n_symbols"] / words, m["n_shouts"] / words, m["n_upper"] / letters, m["n_repeat_words"] / words, m["n_stutter"] / words, m["n_dup_lines"] / lines]
    out = np.zeros((len(texts), SHAPES + 256), np.float32)
    for k, share in enumerate(shares):
        out[:, k] = np.tanh(4 * share)
    out[:, 6] = np.log1p(m["n_words"]) / 10
    out[:, 7] = np.minimum(m["word_chars"] / words, 30) / 10
    out[:, 8] = np.minimum(words / lines, 50) / 50
    for k, text in enumerate(texts):
        if text:
            out[k, SHAPES:] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Twice the estimated chance of quality, less one."""
        return x.astype(float) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SHARP * self.decision(x), -30, 30)))


@dataclass
class Moments:
    """Number of texts and sums of (1, features) and of its products with itself: all that the risk's squared loss needs."""

    n: int
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = np.hstack((np.ones((len(x), 1)), x.astype(float)))
        return cls(len(x), x.T @ x)

    @classmethod
    def none(cls) -> Moments:
        return cls(0, np.zeros((SHAPES + 257, SHAPES + 257)))

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.products + other.products)

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        products = self.products / max(self.n, 1)
        return products, products[0]


def _ridge(unlabelled: Moments, positives: int) -> np.ndarray:
    """Penalty of each weight but the constant, by its feature's spread; more where there are few positives."""
    products, mean = unlabelled.means()
    spread = np.sqrt(np.maximum(np.diag(products) - mean**2, 0)[1:]) + FLAT
    return np.diag(np.concatenate(([0], RIDGE * (1 + 4 * len(mean) / max(positives, 1)) * spread**2)))


def density_ratio(positive: Moments, unlabelled: Moments) -> np.ndarray:
    """Weights of the least-squares estimate of how much denser positives are at a text than all texts are."""
    products, _ = unlabelled.means()
    return np.linalg.solve(products + _ridge(unlabelled, positive.n), positive.means()[1])


def minimise(positive: Moments, unlabelled: Moments, prior: float) -> tuple[np.ndarray, float]:
    """Weights of least prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), and the second part.

    The loss is the squared one, so the risks are quadratic in the weights and
    known from the moments. Where the second part is not negative without the
    maximum, that solution is the one sought. Otherwise the part counts in a
    share t between 0 and 1, the largest for which it isn't negative (where
    the maximum has its kink, every such t is a slope of it).
    """
    of_p, mean_p = positive.means()
    of_u, mean_u = unlabelled.means()
    ridge = _ridge(unlabelled, positive.n)

    def solution(t: float) -> tuple[np.ndarray, float]:
        w = np.linalg.solve(prior * (1 - t) * of_p + t * of_u + ridge, prior * (1 + t) * mean_p - t * mean_u)
        wrong = lambda products, mean: 1 + 2 * mean @ w + w @ products @ w
        return w, float(wrong(of_u, mean_u) - prior * wrong(of_p, mean_p))

    w, rest = solution(1.0)
    if rest < 0:
        low, high = 0.0, 1.0
        for _ in range(40):
            t = (low + high) / 2
            w, rest = solution(t)
            low, high = (t, high) if rest >= 0 else (low, t)
        w, rest = solution(max(low, 1e-6))
    return w, rest


def _prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among all texts, from counts of both at or above each density ratio.

    Where all texts are least dense against the positives, over the upper part
    of these, they are taken to be positives only.
    """
    p, u = positive[::-1].cumsum()[::-1] / max(positive.sum(), 1), unlabelled[::-1].cumsum()[::-1] / max(unlabelled.sum(), 1)
    upper = (p >= 0.4) & (p <= 0.98)
    return float(np.clip((u[upper] / p[upper]).min(initial=1.0), 0.05, 0.99))


def _histogram(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(np.floor((values - LOW) / (HIGH - LOW) * BINS), 0, BINS - 1).astype(np.int64), minlength=BINS)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, without negatives; each half's ratios are by the other half's weights."""
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    found = [np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)]
    for own, other in (halves, halves[::-1]):
        w = density_ratio(Moments.of(other[0]), Moments.of(other[1]))
        for k in (0, 1):
            found[k] += _histogram(own[k].astype(float) @ w[1:] + w[0])
    return _prior(*found)


def _model(positive: Moments, unlabelled: Moments, prior: float) -> Model:
    w, _ = minimise(positive, unlabelled, prior)
    return Model(w[1:], float(w[0]), prior)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """A model from arrays of features: what ``fit`` does, on one machine."""
    if not len(positive) or not len(unlabelled):
        return CONSTANT
    return _model(Moments.of(positive), Moments.of(unlabelled), estimate_prior(positive, unlabelled) if prior is None else prior)


#: Nothing is known of what quality is: every text has it.
CONSTANT = Model(np.zeros(SHAPES + 256), 1.0, 1.0)


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _half(doc_id) -> Column:
    """Which half of the documents a row is in, for estimates of one half by the other."""
    return F.coalesce(F.pmod(F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 3), F.lit(2)), F.lit(0)).cast("int")


def _kinds(part) -> Iterator[tuple[int, pa.Array]]:
    """Rows of all texts of each half (0, 1), and of the positives among them (2, 3)."""
    half, positive = part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
    for k in (0, 1):
        yield k, half == k
        yield k + 2, (half == k) & positive


@tidied
def _sum_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, half, positive) to the task's moments by kind."""
    sums: dict[int, Moments] = {}
    for batch in batches:
        for start, stop in slices(batch.column(0)):
            part = batch.slice(start, stop - start)
            x = features(as_bytes(part.column(0)))
            for kind, rows in _kinds(part):
                if rows.any():
                    sums[kind] = sums.get(kind, Moments.none()) + Moments.of(x[rows])
    place = TaskContext.get().partitionId()
    upper = np.triu_indices(SHAPES + 257)
    yield _sums_batch([(kind, place, m.n, m.products[upper].tobytes()) for kind, m in sorted(sums.items())])


SUMS = "kind int, place long, n long, sums binary"


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "place", "n", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Adds what comes of ``width`` neighbouring places, in its order, by kind."""
    now, found = None, {}

    def out() -> pa.RecordBatch:
        rows = _sums_batch([(kind, place, n, total.tobytes()) for kind, (place, n, total) in found.items()])
        found.clear()
        return rows

    for batch in batches:
        for kind, place, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place // width != now:
                yield out()
                now = place // width
            own = found.setdefault(kind, [place, 0, 0.0])
            own[1], own[2] = own[1] + n, own[2] + np.frombuffer(raw, np.float64)
    yield out()


def _moments(rows: DataFrame) -> list[Moments]:
    """Moments by kind, summed over tasks level by level, 32 to 1, and in a fixed order, so reruns agree."""
    sums = rows.mapInArrow(_sum_moments, SUMS)
    for width in (32, 32**2, 32**3):
        group = F.floor(F.col("place") / width).cast("long")
        sums = sums.repartition(shuffle_partitions(rows.sparkSession), group).sortWithinPartitions(group, "place", "kind").mapInArrow(partial(_add_up, width=width), SUMS)
    out, upper = [Moments.none() for _ in range(4)], np.triu_indices(SHAPES + 257)
    for r in sums.repartition(1).sortWithinPartitions("place", "kind").mapInArrow(partial(_add_up, width=1 << 62), SUMS).collect():  # 4 rows of 0.3 MB at most
        products = np.zeros((SHAPES + 257, SHAPES + 257))
        products[upper] = np.frombuffer(bytes(r.sums), np.float64)
        out[r.kind] = Moments(r.n, products + np.triu(products, 1).T)
    return out


@tidied
def _count_ratios(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(text, half, positive) to the task's counts by kind and density ratio, each half's by the other half's weights."""
    counts = np.zeros((4, BINS), np.int64)
    for batch in batches:
        for start, stop in slices(batch.column(0)):
            part = batch.slice(start, stop - start)
            x = features(as_bytes(part.column(0))).astype(float)
            for kind, rows in _kinds(part):
                w = weights[1 - kind % 2]
                counts[kind] += _histogram(x[rows] @ w[1:] + w[0])
    kind, place = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), pa.array(counts[kind, place])], ["kind", "place", "n"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from trusted positives (labelled 1, not held out) and all texts, which are the unlabelled sample.

    Labels of held-out rows are never used, and of the others only whether
    they are 1: no negative label is. At most ``sample`` positives are taken,
    the first by hash of the id; the texts of all documents count. A first
    pass sums the moments of both in two halves. They give the density ratio
    of each half; a second pass counts all texts and the positives by the
    other half's ratio, from which the prior is estimated. The weights that
    minimise the non-negative risk follow from moments and prior.

    Of rows of ``labels`` that share an id the least label counts; ties and
    repeated rows of documents count as often as they occur. Without a
    positive, or without documents, nothing can be learnt: the model is
    constant and predicts 1 throughout.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("positive_id"))  # at most sample ids of 8 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("positive_id"), "left")
    rows = rows.select("text", _half(F.col("doc_id")).alias("half"), F.col("positive_id").isNotNull().alias("positive"))
    sums = _moments(rows)
    unlabelled, positive = sums[0] + sums[1], sums[2] + sums[3]
    if not positive.n:
        return CONSTANT
    halves = [density_ratio(sums[k + 2], sums[k]) if sums[k + 2].n else density_ratio(positive, unlabelled) for k in (0, 1)]
    counts = np.zeros((4, BINS), np.int64)
    found = rows.mapInArrow(partial(_count_ratios, weights=halves), "kind long, place long, n long").groupBy("kind", "place").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most 4 * BINS rows
        counts[r.kind, r.place] = r.n
    return _model(positive, unlabelled, _prior(counts[2] + counts[3], counts[0] + counts[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Whole texts are scored, very long ones too; null and empty texts get the
    score of an empty text; repeated rows are scored alike; a score of 0.5
    counts as 1; no rows give no rows; extra columns are ignored.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                scores = model.scores(features(as_bytes(batch.column(1)[start:stop])))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality (pipeline form)."""
    model = fit(docs, labels)
    names = [f.name for f in docs.schema.fields]
    place = names.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                good = model.scores(features(as_bytes(part.column(place)))) >= 0.5
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
