"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of the document hash that one histogram covers, and how many histograms refine each other.
LEVEL_BITS, LEVELS = 12, 4
#: Up to so many sources their thresholds are broadcast (under 20 MB); more are joined by salted source.
BROADCAST_SOURCES = 100_000
SALTS = 64


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey (source, never null), size in words and a 48-bit hash of the id."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.coalesce(F.expr(r"cast(regexp_count(text, '[^\\x20\\x09-\\x0D]+') as long)"), F.lit(0).cast("long")).alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long").alias("h"),
    )


def _targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """skey, source_size, target: weighted shares of ``share`` times all words, none above ``most`` times its source.

    Sources in order of the largest multiple of their weight that they can
    give: those before some place are full, and the others share the rest by
    weight, so one pass of running sums finds the shares.
    """
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", weight)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("skey")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    rows = rows.withColumn("before_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before_size") * F.lit(float(most))) / (F.sum("w").over(everything) - F.col("before_w")))
    rows = rows.withColumn("full", F.col("source_size") * F.lit(float(most)) <= F.col("level") * F.col("w"))
    # the level falls once a source isn't full, so the largest of those is the first
    rows = rows.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return rows.select("skey", "source_size", F.when(F.col("full"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("level") * F.col("w")).alias("target"))


def _slot(level: int):
    return F.shiftrightunsigned("h", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, split: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Every document of a source is taken as often as the source's target
    allows (never, once, ...), and documents below the source's hash threshold
    once more. Thresholds come from nested histograms of words by source and
    hash bucket; each refines only the one bucket in which the budget ends, so
    nothing is sorted. Documents whose hash equals the last threshold give
    part of their words (``split``), in proportion, or with ``split=False``
    all or none, whichever is nearer. The hash is of doc_id, so reruns agree.

    Null or empty text: size 0, taken 0. Very long texts count whole, so a
    source of one is near its target only with ``split``. Ties in the hash
    share what is left at the threshold. Null sources are one source, last.
    Repeated rows count as often as they occur. No rows give no rows. Extra
    columns are ignored. With a single document in a source the part taken is
    exact only with ``split``.
    """
    rows = cut(_hashed(docs))
    budgets = _targets(rows, weights, share, most)
    budgets = budgets.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    budgets = budgets.withColumn("left_over", F.greatest(F.lit(0), F.round(F.col("target") - F.col("base") * F.col("source_size"))).cast("long"))
    budgets = cut(budgets)
    keys: list[str] = ["skey"]
    bound = budgets.select("skey", "left_over")
    part = rows.where("size > 0").select("skey", "size", "h")
    for level in range(LEVELS):
        slot = f"slot{level}"
        if level:
            part = part.join(F.broadcast(bound.select(*keys)) if small else bound.select(*keys), keys)
        part = part.withColumn(slot, _slot(level))
        histogram = part.groupBy(*keys, slot).agg(F.sum("size").alias("words"))
        running = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("below", F.coalesce(F.sum("words").over(running), F.lit(0)))
        bound = cut(
            histogram.join(bound.select(*keys, "left_over"), keys).where("below <= left_over and left_over < below + words")
            .withColumn("left_over", F.col("left_over") - F.col("below")).select(*keys, slot, "words", "left_over")
        )
        if not level:
            small = bound.count() <= BROADCAST_SOURCES
        keys.append(slot)
    # a source without a boundary gives all its words once more: only where nothing is left over or the rest is whole
    threshold = F.lit(0).cast("long")
    for level in range(LEVELS):
        threshold = threshold * F.lit(1 << LEVEL_BITS) + F.col(f"slot{level}")
    bound = bound.select("skey", threshold.alias("threshold"), F.col("words").alias("edge_words"), F.col("left_over").alias("edge_left"))
    plan = budgets.join(bound, "skey", "left")
    if small:
        joined = rows.join(F.broadcast(plan), "skey")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"])
    at_edge = F.floor(F.col("edge_left") * F.col("size") / F.col("edge_words")) if split else F.when(F.col("edge_left") * 2 >= F.col("edge_words"), F.col("size")).otherwise(F.lit(0))
    more = (
        F.when(F.col("left_over") == 0, F.lit(0))
        .when(F.col("threshold").isNull() | (F.col("h") < F.col("threshold")), F.col("size"))
        .when(F.col("h") == F.col("threshold"), at_edge)
        .otherwise(F.lit(0))
    )
    return joined.select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size") + more).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them whole (pipeline form).

    Decisions are by doc_id; rows that share one are decided together.
    """
    taken = mix_sources(docs, split=False, **options).where("taken > 0 or size = 0")
    times = taken.groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1))).cast("int").alias("_times"))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["doc_id"])).select(*(docs[c] for c in docs.columns), "_times")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op6_mixing(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents
), s AS (
  SELECT skey, source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY skey, source
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER b, 0)::DOUBLE * 2::DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM s WINDOW b AS (ORDER BY source_size::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, source_size * 2::DOUBLE <= level * w AS is_full FROM l
), t AS (
  SELECT skey, source_size, CASE WHEN is_full THEN source_size * 2::DOUBLE ELSE max(level) FILTER (NOT is_full) OVER () * w END AS target FROM f
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM t
), r AS (SELECT *, greatest(0, round(target - base * source_size))::BIGINT AS left_over FROM g
), c AS (
  SELECT d.doc_id, d.size, d.h, r.*,
         coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
         sum(d.size) OVER (PARTITION BY d.skey, d.h)::BIGINT AS here FROM d JOIN r USING (skey)
)
SELECT doc_id, size, source_size, target,
       (base * size + CASE WHEN below + here <= left_over THEN size WHEN below <= left_over AND here > 0
                           THEN (left_over - below) * size // here ELSE 0 END)::BIGINT AS taken FROM c
"""
